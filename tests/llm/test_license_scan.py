import re

from pyspark.sql import functions as F

from tableproof.llm.license_scan import KNOWN, canonical, known_digests, scan
from tableproof.llm.license_texts import all_known, whole_texts


def test_spellings_and_copyright_lines(spark):
    mit = KNOWN[0][1]
    odd = "Copyright (c) 2020 Somebody\n(C) 2021 B\n * © 2022 C\n" + mit.upper().replace('"', "“").replace("SUBLICENSE", "sublicence").replace(" ", "  \n", 9)
    rows = [(1, mit), (2, odd), (3, mit + " plus"), (4, None), (5, ""), (6, "..."), (7, "Copyright X"), (8, mit), (8, mit),
            (9, "text\nLicenced under the APACHE licence -- version 2.0\nmore\r\nReleased under the MIT License."), (None, mit), (10, "x " * 200_000)]
    docs = spark.createDataFrame([(*r, "d", "l") for r in rows], "doc_id bigint, text string, digest string, license_id string")
    got = [tuple(r) for r in scan(docs, known_digests(spark)).collect()]
    assert len(got) == len(rows)
    by = {}
    for i, sha, licence, notices in got:
        by.setdefault(i, []).append((licence, notices, sha))
    assert [x[0] for i in (1, 2, 8, None) for x in by[i]] == ["MIT"] * 5
    assert by[1][0][2] == by[2][0][2]
    assert all(by[i][0][:2] == (None, "") for i in (3, 4, 5, 6, 7, 10))
    assert by[4][0][2] == by[6][0][2] == by[7][0][2]
    assert by[9][0][:2] == (None, "Apache-2.0,MIT")
    plan = scan(docs, known_digests(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert scan(docs.limit(0), known_digests(spark)).count() == 0


def test_common_licences_and_wordings(spark):
    texts = {i: t for i, t in whole_texts()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(texts)
    ids = sorted(texts)
    lines = {
        "# This program is licensed under the GNU General Public License, version 2.": "GPL-2.0",
        "Licensed under the BSD 3-Clause License": "BSD-3-Clause",
        "SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1-or-later",
        "// Released under the terms of the GPLv3 license": "",
        "Distributed under the Mozilla Public License v2.0": "MPL-2.0",
        "This work is licensed under a licence of our own": "",
        "Licensed under CC BY-SA 4.0.": "CC-BY-SA-4.0",
        "License: Apache-2.0": "Apache-2.0",
    }
    rows = [(n, "Copyright (c) 2021 Somebody\n\n" + texts[i].replace("\n", "\r\n")) for n, i in enumerate(ids)] + [(100 + n, "other text\n" + x) for n, x in enumerate(lines)]
    known = known_digests(spark, all_known())
    got = {r.doc_id: (r.license_id, r.notices) for r in scan(spark.createDataFrame(rows, "doc_id bigint, text string"), known).collect()}
    assert [got[n][0] for n in range(len(ids))] == ids
    assert [got[100 + n] for n in range(len(lines))] == [(None, x) for x in lines.values()]
    # No text names two licences.
    table = spark.createDataFrame(all_known(), "license_id string, text string")
    assert table.groupBy(canonical(F.col("text"))).agg(F.collect_set("license_id").alias("ids")).where("size(ids) > 1").collect() == []
