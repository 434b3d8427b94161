"""License scans against brute force, with nulls, empty and repeated texts, very long texts, and shifted or broken notices."""

import math
import re

from pyspark.sql import functions as F

from batchloom.llm import licences

GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return [w for w in GAP.split(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def starts(ws, phrase):
    parts = phrase.split(" ")
    return [i for i in range(len(ws) - len(parts) + 1) if ws[i : i + len(parts)] == parts]


def brute(rows):
    files = [(d, words(t)) for d, t in rows]
    known = licences.templates()
    df = {w: sum(w in ws for _, ws in files) for t in known for w in t.words}
    rarity = {w: max(1, round(1000 * math.log((len(files) + 1) / (n + 1)))) for w, n in df.items()}
    out = []
    for d, ws in files:
        base = sorted((i, label) for p, label in licences.BASE.items() for i in starts(ws, p))
        labels, best = {b for _, b in base}, 0.0
        for t in known:
            anchors = sorted(set(t.words), key=lambda w: (-rarity[w], w))[: licences.ANCHORS]
            total = sum(rarity[w] for w in anchors)
            for start in range(-len(t.words), len(ws)):
                if all(start + at in starts(ws, p) for p, at in t.phrases):
                    held = sum(rarity[w] for w in anchors if 0 <= start + t.words.index(w) < len(ws) and ws[start + t.words.index(w)] == w)
                    if held / total >= licences.SHARE:
                        labels.add(t.label)
                        best = max(best, held / total)
        out.append((d, len(ws), len(base), sorted({b for _, b in base}), sorted(labels), 1.0 if base else best))
    return sorted(out)


def scanned(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("mine"), "w": F.lit(1), "LIC_SCORE": F.lit("x"), "hits": F.lit(0)})
    got = licences.scan(df, ["doc_id"])
    return sorted((r.doc_id, r.lic_words, len(r.lic_base), list(r.lic_base_labels), list(r.lic_labels), r.lic_score) for r in got.collect()), got


NOTICES = [
    "Released under the MIT License.", "x y Licensed under CC BY-NC 4.0. z", "licensed under cc by-sa 4.0", "This work is licensed under the GNU General Public License, version 3.",
    "GNU General Public\nLicense", "the apache license and the MIT-license; mit license", "Licensed under the Apache License, Version 2.0 (the License)", "Licensed under the Apache License, Version 1.1",
    "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation files, to deal in the Software without\n * restriction, including without limitation the rights to use, copy, modify, merge,\n * publish, distribute, sublicense, and/or sell copies */",
    "publish distribute sublicense", "Redistribution and use in source and binary forms", "free and unencumbered software was released into the public domain", "GNÜ general public license", None, "", "...", "plain prose about nothing at all", "cc by", "ccby cc  by",
    "under the terms of the GNU Lesser General Public License", "mit mit license license",
]


def test_license_scan_matches_brute_force(spark):
    rows = list(enumerate(NOTICES)) + [(100, NOTICES[0]), (100, NOTICES[0]), (101, " ".join(["prose"] * 500 + [NOTICES[8]] + ["more"] * 300)), (102, "Licensed under CC BY-NC 4.0. " * 50)] + [(200 + i, "filler words in a file") for i in range(40)]
    got, frame = scanned(spark, rows)
    assert got == brute(rows)
    labels = {d: x for d, *_, x, _ in got}
    assert labels[1] == ["cc-by", "cc-by-nc"] and labels[3] == ["gpl", "gpl-3.0"] and labels[8] == ["mit"] and labels[9] == [] and labels[11] == []
    assert not re.search("Python|Pandas|Arrow", frame._jdf.queryExecution().executedPlan().toString())


def test_license_scan_of_a_long_text_and_of_nothing(spark):
    text = "word " * 200_000 + "Released under the MIT License. " * 2000
    got, _ = scanned(spark, [(1, text), (2, "nothing here")])
    assert got[0][1:5] == (210_000, 2000, ["mit"], ["mit"]) and got[1][2:] == (0, [], [], 0.0)
    assert scanned(spark, [])[0] == []
