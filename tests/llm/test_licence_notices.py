"""Recall on real notices among other words, false alarms on the corpus, the unknown class."""

import random
import time

import pytest
from pyspark.sql import functions as F

from threadloom.llm import licences
from threadloom.session import table

DATA = "/root/testdata/sf0.01"
NOTICES = [
    ("Apache-2.0", "// SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "# SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish"),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


@pytest.fixture(scope="module")
def scanner(spark):
    return licences.fit(table(spark, DATA, "documents"))


def found(spark, scanner, rows):
    out = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.explode(licences.scan(scanner)).alias("x"))
    return [(r.doc_id, r.x.family) for r in out.collect()]


def test_real_notices_among_other_lines(spark, scanner):
    rng = random.Random(4)
    lines = [x for r in table(spark, DATA, "documents").orderBy("doc_id").limit(300).collect() for x in (r.text or "").split("\n") if x]
    rows, want = [], set()
    for i in range(8 * len(NOTICES)):
        family, notice = NOTICES[i % len(NOTICES)]
        rows.append((i, "\n".join([*rng.sample(lines, 2), notice, rng.choice(lines)])))
        want.add((i, family))
    got = set(found(spark, scanner, rows))
    assert len(got & want) >= 0.95 * len(want), sorted(want - got)


def test_unknown_licences_and_clean_text(spark, scanner):
    strange = ["SPDX-License-Identifier: Foobar-7.0", "This file may be used under the terms of the Wombat Public License, version 9, as published by the Wombat Foundation."]
    got = found(spark, scanner, list(enumerate(strange)))
    assert not [f for _, f in got if f != "unknown"] and got
    docs = table(spark, DATA, "documents").where("not lower(text) rlike 'licen[sc]e|copyright|cc[ -]by|cc0|proprietary|gpl|rights reserved|public domain'")
    alarms = docs.select(F.explode(licences.scan(scanner))).count()
    assert alarms <= 0.005 * docs.count()


def test_no_rows(spark):
    began = time.time()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert empty.select(F.explode(licences.scan(licences.fit(empty)))).count() == 0 and time.time() - began < 60
