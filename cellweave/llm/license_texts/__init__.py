"""Full texts, one file for each licence, and the standard headers and short licences, which files hold over several lines."""

from importlib import resources

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS"'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_NO_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_END = f"""The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
{_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_END = f"""{_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
_APACHE_END = """http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


def _gnu(kind: str, version: str, it: str) -> list[str]:
    first = f"This {it} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."
    rest = f"This {it} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} Public License for more details.\nYou should have received a copy of the GNU {kind} Public License along with this {it}. If not, see <http://www.gnu.org/licenses/>."
    return [first, f"{first}\n{rest}"]


def _found_in(name: str) -> str:
    return f"This source code is licensed under the {name} license found in the LICENSE file in the root directory of this source tree."


#: (licence, text) to score blocks of lines against, and whole texts against.
HEADERS = [
    *[("Apache-2.0", t) for t in (_APACHE, f"{_APACHE}\n{_APACHE_END}", "Apache License Version 2.0, January 2004")],
    *[("MIT", t) for t in (_MIT, f"{_MIT}\n{_MIT_END}", _found_in("MIT"), "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.")],
    *[("BSD-3-Clause", t) for t in (_NO_NAMES, f"{_BSD}\n3. {_NO_NAMES}\n{_BSD_END}", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _found_in("BSD-style"))],
    ("BSD-2-Clause", f"{_BSD}\n{_BSD_END}"),
    *[("ISC", t) for t in (_ISC, f"{_ISC}\n{_ISC_END}")],
    *[("GPL-2.0", t) for t in (*_gnu("General", "2", "program"), "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "GNU GENERAL PUBLIC LICENSE Version 2")],
    *[("GPL-3.0", t) for t in (*_gnu("General", "3", "program"), "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE Version 3")],
    *[("AGPL-3.0", t) for t in (*_gnu("Affero General", "3", "program"), "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007")],
    *[("LGPL-2.1", t) for t in (*_gnu("Lesser General", "2.1", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999")],
    *[("LGPL-3.0", t) for t in (*_gnu("Lesser General", "3", "library"), "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007")],
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]


def whole() -> list[tuple[str, str]]:
    """The texts of licence files."""
    files = [(f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in resources.files(__name__).iterdir() if f.name.endswith(".txt")]
    return sorted(files) + [("MIT", f"MIT License\n{_MIT}\n{_MIT_END}"), ("ISC", f"ISC License\n{_ISC}\n{_ISC_END}"), ("BSD-3-Clause", f"{_BSD}\n3. {_NO_NAMES}\n{_BSD_END}"), ("BSD-2-Clause", f"{_BSD}\n{_BSD_END}")]
