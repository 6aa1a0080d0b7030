"""Licence scan on whole licence texts, wrapped and in one line."""

import textwrap

from docketry.llm import licenses
from tests.llm.test_text_operators import table

MIT = [
    "MIT License", "Copyright (c) 2020 A. Person",
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.',
]
BSD = [
    "Copyright (c) 2020, A. Person\nAll rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
]
GPL = [
    "This program is free software%s you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation%s either version %s of the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
]
APACHE = [
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
]
ISC = ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."]


def test_whole_texts_are_found_wrapped_and_in_one_line(spark):
    gpl3 = [GPL[0] % (":", ",", "3"), GPL[1]]
    gpl2 = [GPL[0] % (";", ";", "2"), GPL[1]]
    cases = {
        "GPL-2.0": gpl2,
        "MIT": MIT, "BSD-2-Clause": BSD[1:], "GPL-3.0": gpl3, "Apache-2.0": APACHE, "ISC": ISC,
        "BSD-2-Clause,Proprietary": BSD,
    }
    rows, want = [], {}
    for license, parts in cases.items():
        for lay in (
            "\n\n".join(parts), "\n\n".join(textwrap.fill(p, 72) if "\n" not in p else p for p in parts),
            "\n *\n".join(textwrap.indent(textwrap.fill(p, 60), " * ") for p in parts) if license not in ("BSD-2-Clause,Proprietary",) else "\r\n\r\n".join(parts),
            " ".join(parts) if license in ("GPL-3.0", "ISC", "BSD-2-Clause") else "\n\n".join(parts),
        ):
            want[len(rows)] = license
            rows.append((len(rows), lay))
    got = {r.doc_id: r.licenses for r in licenses.scan(table(spark, rows)).collect()}
    assert got == want
