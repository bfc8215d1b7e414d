"""Longer forms of licences: whole short licences, standard file headers, openings of long licences, identifier lines."""

from __future__ import annotations

_WARRANTY = (
    " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS"
    " FOR A PARTICULAR PURPOSE. See the GNU"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
    " documentation and/or other materials provided with the distribution."
)
_BSD_THIRD = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this"
    " software without specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,"
    " THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)


def _gnu_header(thing: str, kind: str, version: int) -> str:
    return (
        f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software"
        f" Foundation, either version {version} of the License, or (at your option) any later version. This {thing}{_WARRANTY} {kind} for more details."
    )


def _gnu_file(kind: str, date: str) -> str:
    return (
        f"GNU {kind} {date} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document,"
        " but changing it is not allowed."
    )


# Fixed values: (licence, words of the form).
FORMS = (
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the"
        " \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to"
        " the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the"
        " above copyright notice and this permission notice appear in all copies.",
    ),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may"
        " obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,"
        " software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express"
        " or implied.",
    ),
    (
        "Apache-2.0",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"
        " 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9"
        " of this document.",
    ),
    ("GPL-2.0", _gnu_header("program", "General Public License", 2)),
    ("GPL-3.0", _gnu_header("program", "General Public License", 3)),
    ("AGPL-3.0", _gnu_header("program", "Affero General Public License", 3)),
    ("LGPL-3.0", _gnu_header("library", "Lesser General Public License", 3)),
    ("GPL-2.0", _gnu_file("GENERAL PUBLIC LICENSE", "Version 2, June 1991 Copyright (C) 1989, 1991")),
    ("GPL-3.0", _gnu_file("GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007 Copyright (C) 2007")),
    ("AGPL-3.0", _gnu_file("AFFERO GENERAL PUBLIC LICENSE", "Version 3, 19 November 2007 Copyright (C) 2007")),
    ("LGPL-3.0", _gnu_file("LESSER GENERAL PUBLIC LICENSE", "Version 3, 29 June 2007 Copyright (C) 2007")),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "MPL-2.0",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to"
        " the creation of, or owns Covered Software.",
    ),
)


def identifier_lines(names) -> tuple[tuple[str, str], ...]:
    """The short machine-readable line of each licence."""
    return tuple((name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(names))
