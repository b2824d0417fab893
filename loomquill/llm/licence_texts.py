"""Public licence notices, headers and permission texts, with the key phrases that a match must have."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Template:
    licence: str
    name: str
    text: str
    phrases: tuple[str, ...]


def _notices(licence: str, title: str, *phrases: str) -> list[Template]:
    """One-line notices that name the licence."""
    return [Template(licence, f"{licence} notice: {verb.lower()}", f"{verb} {title}", (f"{verb} {title}", *phrases)) for verb in ("Licensed under", "Released under", "Distributed under", "This work is licensed under")]


_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR
A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
_BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD3 = _BSD2 + """ Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public
License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind}General Public License for more details."""
_LGPL21 = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/"""
_BSL = """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)"""
_0BSD = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR
ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
commercial or non-commercial, and by any means."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely."""

TEMPLATES: tuple[Template, ...] = (
    *_notices("MIT", "the MIT License"),
    *_notices("Apache-2.0", "the Apache License, Version 2.0"),
    *_notices("GPL-2.0", "the GNU General Public License, version 2"),
    *_notices("GPL-3.0", "the GNU General Public License, version 3"),
    *_notices("LGPL-3.0", "the GNU Lesser General Public License, version 3"),
    *_notices("AGPL-3.0", "the GNU Affero General Public License, version 3"),
    *_notices("MPL-2.0", "the Mozilla Public License, version 2.0"),
    *_notices("BSD-2-Clause", "the BSD 2-Clause License"),
    *_notices("BSD-3-Clause", "the BSD 3-Clause License"),
    *_notices("CC0-1.0", "CC0 1.0"),
    *_notices("CC-BY-4.0", "CC BY 4.0"),
    *_notices("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    *_notices("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    *_notices("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    *_notices("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    *_notices("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
    *_notices("CC-BY-4.0", "a Creative Commons Attribution 4.0 International License"),
    *_notices("CC-BY-SA-4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License"),
    *_notices("CC-BY-NC-4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    *_notices("EPL-2.0", "the Eclipse Public License, version 2.0"),
    *_notices("BSL-1.0", "the Boost Software License, Version 1.0"),
    *_notices("ISC", "the ISC License"),
    *_notices("WTFPL", "the WTFPL"),
    Template("MIT", "MIT text", _MIT, ("permission is hereby granted free of charge", "the software is provided as is")),
    Template("ISC", "ISC text", _ISC, ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("Apache-2.0", "Apache-2.0 header", _APACHE, ("licensed under the apache license version 2.0", "you may not use this file except in compliance")),
    Template("BSD-2-Clause", "BSD-2-Clause text", _BSD2, ("redistribution and use in source and binary forms", "redistributions in binary form must reproduce")),
    Template("BSD-3-Clause", "BSD-3-Clause text", _BSD3, ("redistribution and use in source and binary forms", "to endorse or promote products derived")),
    *(Template(f"{'L' * (k == 'Lesser ') + 'A' * (k == 'Affero ')}GPL-{v}.0-or-later", f"{k}GPL {v} header", _GPL.format(kind=k, v=v), (f"terms of the gnu {k}general public license", f"either version {v} of the license")) for k, v in (("", 2), ("", 3), ("Lesser ", 3), ("Affero ", 3))),
    Template("LGPL-2.1-or-later", "LGPL 2.1 header", _LGPL21, ("terms of the gnu lesser general public license", "either version 2.1 of the license")),
    Template("EPL-2.0", "EPL-2.0 header", _EPL, ("are made available under the terms of the eclipse public license 2.0",)),
    Template("BSL-1.0", "BSL-1.0 text", _BSL, ("boost software license version 1.0",)),
    Template("0BSD", "0BSD text", _0BSD, ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "in no event shall the author be liable")),
    Template("MPL-2.0", "MPL-2.0 header", _MPL, ("subject to the terms of the mozilla public license v 2.0",)),
    Template("Unlicense", "Unlicense text", _UNLICENSE, ("free and unencumbered software released into the public domain",)),
    Template("Zlib", "Zlib text", _ZLIB, ("provided as is without any express or implied warranty", "alter it and redistribute it freely")),
)
