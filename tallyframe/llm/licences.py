"""License scans: MinHash bands over overlapping text windows (built-in functions only).

Texts become lower-case words of letters and digits. For each width of templates (in words) a text is cut into
overlapping windows of that many words, each an eighth of a window after the last (one word for widths below 16), so some window lies within
a sixteenth of its width of any template occurrence. A window's five-word shingles (as 64-bit hashes, each made once a text) give minimum hashes in BANDS bands of ROWS; windows that share a
band with a template of their width retrieve it. At Jaccard similarity 0.7 a band collides with probability 1 - (1 - 0.7**ROWS)**BANDS,
above 0.99; a window that equals the template always collides. Retrieved templates are verified: the share of the template's
shingles found in the window with half a window of margin on both sides must reach `containment`. Where another license's template holds that share
of it too (notices that differ in a version number), a shingle that the other lacks must be among those found, so each notice tells its own license.
A clause that several licenses share stands for their family ("BSD"). A match near a shingle that denies the notice ("not licensed under the") is none.

Windows without any anchor word are not hashed: every template keeps fewer than `containment` of its shingles when those with
anchors are taken away, which is checked when the templates are loaded, so no match is lost.

Defined results: null, empty and short texts match nothing but templates that fit in them; repeated rows are scanned each for itself; ids
may be null or repeat; an empty table gives no rows. The templates are a fixed list, broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE, BANDS, ROWS = 5, 10, 2
#: Public license notices.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "BSD-2-Clause": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "CC-BY-NC-SA-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-ND-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-ND 4.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
#: Words that deny a notice that they open, as in "not licensed under".
DENIALS = (["not"], ["never"], ["nor"], ["isn", "t"])
#: Words of which every template has some in most of its shingles.
ANCHORS = "license|licensed|licence|permission|permitted|redistribution|redistribute|public|copyright|software|mozilla|unencumbered|warranties"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def shingle_hashes(words: Column) -> Column:
    """The hash of the shingle that starts at each word; fewer words than SHINGLE have none."""
    starts = F.sequence(F.lit(1), F.size(words) - SHINGLE + 1)
    return F.when(F.size(words) < SHINGLE, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, SHINGLE), " "))))


def seeded(hashes: Column) -> Column:
    """For each of the BANDS * ROWS hash functions its values of all shingles."""
    return F.array(*[F.transform(hashes, _with_seed(k)) for k in range(BANDS * ROWS)])


def _with_seed(seed: int):
    return lambda h: F.xxhash64(h, F.lit(seed))


def bands(values: Column, start: Column, length: Column) -> Column:
    """A hash for each band of the minima over a stretch of shingles, the band's number in it."""

    def least(k: int) -> Column:
        return F.array_min(F.slice(F.get(values, F.lit(k)), start, length))

    return F.array(*[F.xxhash64(F.lit(b), *[least(b * ROWS + r) for r in range(ROWS)]) for b in range(BANDS)])


def load_templates(spark: SparkSession, templates: dict[str, list[str]] | None = None, containment: float = 0.8) -> list[dict]:
    """license, width in words, own (distinct shingle hashes), bands and marks of each template: a fixed list, so it comes to the driver."""
    rows = [(name, text) for name, texts in (templates or TEMPLATES).items() for text in texts]
    words = spark.createDataFrame(rows, "license string, template string").select("license", words_of(F.col("template")).alias("w"))
    hashed = words.select("license", "w", shingle_hashes(F.col("w")).alias("h")).withColumn("m", seeded(F.col("h")))
    out = hashed.select("license", "w", F.array_distinct("h").alias("own"), bands(F.col("m"), F.lit(1), F.size("h")).alias("bands")).collect()
    anchors, found = set(ANCHORS.split("|")), []
    for r in out:
        each = [r["w"][i : i + SHINGLE] for i in range(len(r["w"]) - SHINGLE + 1)]
        if not each or sum(not anchors & set(x) for x in each) >= containment * len(set(map(tuple, each))):
            raise ValueError(f"template without enough anchor words: {' '.join(r['w'])}")
        denied = [" ".join([*no, *r["w"][at : at + SHINGLE - len(no)]]) for no in DENIALS for at in (0, r["w"].index("licensed") if "licensed" in r["w"] else 0)]
        found.append({"license": r["license"], "width": len(r["w"]), "own": r["own"], "bands": r["bands"], "denied": sorted(set(denied))})
    rows = [(i, t["denied"]) for i, t in enumerate(found)]
    hashed = spark.createDataFrame(rows, "i int, d array<string>").select("i", F.transform("d", lambda x: F.xxhash64(x)).alias("h")).collect()
    for r in hashed:
        found[r["i"]]["denied"] = r["h"]
    for t in found:  # what tells t from each template of another license that it could be taken for
        others = [set(t["own"]) - set(u["own"]) for u in found if u["license"] != t["license"]]
        t["marks"] = [sorted(m) for m in others if len(m) <= (1 - containment) * len(t["own"])]
        if not all(t["marks"]):
            raise ValueError(f"a template of {t['license']} stands whole in another license's")
    return found


def scan(docs: DataFrame, text: str = "text", containment: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """A row for each row of docs, license found in it and window that shows it: docs' columns, license, containment."""
    known = load_templates(docs.sparkSession, templates, containment)
    docs = docs.drop("license", "containment")
    # written, as an expression that a lambda reads would be evaluated anew for each element once the optimiser moves it there
    anchored = written(docs.where(F.lower(text).rlike(rf"({ANCHORS})")).select(*docs.columns, words_of(F.col(text)).alias("_w")), "anchored")
    is_anchor = F.transform("_w", lambda w: w.rlike(rf"^({ANCHORS})$"))
    places = F.filter(F.transform(is_anchor, lambda a, i: F.when(a, i)), lambda i: i.isNotNull())
    hashed = written(anchored.select(*docs.columns, shingle_hashes(F.col("_w")).alias("_h"), places.alias("_at")), "shingles").withColumn("_m", seeded(F.col("_h")))

    def windows(width: int) -> Column:
        """Structs (width, start) of the windows of a width that hold an anchor, an eighth of a window apart."""
        stride = max(1, width // 8)
        back = F.sequence(F.lit(0), F.lit(-(-width // stride)))
        starts = F.flatten(F.transform("_at", lambda i: F.transform(back, lambda k: (F.floor(i / stride).cast("int") - k) * stride)))
        starts = F.filter(F.array_distinct(starts), lambda x: (x >= 0) & (x < F.size("_h")))
        return F.transform(starts, lambda x: F.struct(F.lit(width).alias("width"), x.alias("start")))

    every = F.concat(*[windows(w) for w in sorted({t["width"] for t in known})])
    banded = F.transform(every, lambda x: F.struct(x["width"].alias("width"), x["start"].alias("start"), bands(F.col("_m"), x["start"] + 1, x["width"] - SHINGLE + 1).alias("bands")))
    template_bands = F.array(*[F.lit(b) for b in sorted({b for t in known for b in t["bands"]})])
    met = hashed.select(*docs.columns, "_h", F.explode(F.filter(banded, lambda x: F.arrays_overlap(x["bands"], template_bands))).alias("_x"))
    half = F.floor(F.col("_x.width") / 2).cast("int")
    region = F.slice("_h", F.greatest(F.lit(1), F.col("_x.start") + 1 - half), F.col("_x.width") * 2)
    wider = F.slice("_h", F.greatest(F.lit(1), F.col("_x.start") + 1 - half - F.col("_x.width")), F.col("_x.width") * 3)  # denials stand ahead
    rows = met.select(*docs.columns, F.col("_x.width").alias("_width"), region.alias("_region"), wider.alias("_wider"), F.explode("_x.bands").alias("_band"))
    table = docs.sparkSession.createDataFrame([(t["license"], t["width"], t["own"], t["marks"], t["denied"], b) for t in known for b in t["bands"]], "license string, _width int, _own array<bigint>, _marks array<array<bigint>>, _denied array<bigint>, _band bigint")
    share = F.size(F.array_intersect("_own", "_region")) / F.size("_own")
    told = F.forall("_marks", lambda m: F.arrays_overlap(m, F.col("_region"))) & ~F.arrays_overlap("_denied", "_wider")
    return rows.join(F.broadcast(table), ["_width", "_band"]).where(told).select(*docs.columns, "license", share.alias("containment")).where(F.col("containment") >= containment)


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))
