"""License scan: notices and texts of known licenses are searched in documents by MinHash containment.

Templates are sentences and headers that stand in works, short licenses in full, and the texts in license_texts, which
are those that Debian's base-files package installs as /usr/share/common-licenses, unchanged. Licenses of one family share
most of their words, so a template that holds its shingles in common with a better match is not reported."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import containment
from sparkloom.llm.common import read

#: License identifiers and the notices that stand in works under them.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at"),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
)
_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_DAMAGES = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Short licenses in full.
SHORT = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", f"{_GRANT} {_DAMAGES}"),
    ("BSD-3-Clause", f"{_GRANT} {_NAMES} {_DAMAGES}"),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
)
TEXTS = Path(__file__).parent / "license_texts"


def templates() -> list[tuple[str, str]]:
    """(license, text) of all templates: notices, short licenses, and the texts in license_texts by name."""
    return [*NOTICES, *SHORT, *((path.name, path.read_text("utf-8")) for path in sorted(TEXTS.iterdir()))]


def scan(docs: DataFrame, notices=None, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, notice, license, n_item, n_found, containment, first_word for each notice found in a document.

    notices: (license, text) pairs, numbered from 0 as notice; without it all templates(). See containment.contained for
    what counts as found; a notice of fewer words than a shingle can't be found. A notice is not reported if another
    license has a better one in the same document that holds half of its found shingles or more: better is the higher
    containment, then more found shingles, then the smaller number. Of two that are complete, only one whose found
    shingles are all in the other gives way, as both can stand there."""
    notices = templates() if notices is None else notices
    items = docs.sparkSession.createDataFrame([(i, name, text) for i, (name, text) in enumerate(notices)], "item_id int, license string, text string")
    found = containment.contained(docs, items, words, percent, evidence=True)
    names = F.broadcast(items.select("item_id", "license"))  # as long as the list above
    fields = ["item_id", "license", "n_item", "n_found", "containment", "first_word", "evidence"]
    places = found.join(names, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("all"))  # one for each notice at most

    def beaten(x: Column) -> Column:
        def by(y: Column) -> Column:
            shared = F.size(F.array_intersect(x["evidence"], y["evidence"]))
            better = F.struct(y["containment"], y["n_found"], -y["item_id"]) > F.struct(x["containment"], x["n_found"], -x["item_id"])
            return (x["license"] != y["license"]) & better & (shared * 2 >= x["n_found"]) & ((x["containment"] < 1) | (shared == x["n_found"]))

        return F.exists("all", by)

    best = places.select("doc_id", F.explode(F.filter("all", lambda x: ~beaten(x))).alias("x"))
    return best.select("doc_id", F.col("x.item_id").alias("notice"), "x.license", "x.n_item", "x.n_found", "x.containment", "x.first_word")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scan() of all documents for all templates: null, empty and short texts hold none, repeated rows of a doc_id count
    once with the best match, no rows give none."""
    return scan(read(spark, sf_dir, "documents"))


def sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quoted(a)}, {quoted(b)})" for i, (a, b) in enumerate(templates()))
    return f"""WITH templates(item_id, license, text) AS (VALUES {values}),
found AS (SELECT f.*, license FROM ({containment.sql('templates', evidence=True)}) f JOIN templates USING (item_id))
SELECT doc_id, item_id::INTEGER AS notice, license, n_item, n_found, containment, first_word FROM found x WHERE NOT EXISTS (SELECT 1 FROM found y
WHERE x.doc_id = y.doc_id AND x.license <> y.license AND (y.containment, y.n_found, -y.item_id) > (x.containment, x.n_found, -x.item_id)
AND len(list_intersect(x.evidence, y.evidence)) * 2 >= x.n_found AND (x.containment < 1 OR len(list_intersect(x.evidence, y.evidence)) = x.n_found))"""


SQL = sql()
