"""Signature rules for license texts, in order. Names, identifiers, addresses and sentences as licenses have them.

Patterns are over plain text: lower-case words with one space between. Every text that a rule matches has a word that begins with its
``stem`` and, if it has one, the word ``keyword``; ``priority`` settles overlaps. Most rules follow from the tables by kind: the name alone, the name in a grant, the
SPDX tag and the address.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    stem: str
    keyword: str
    pattern: str


#: Priorities, and how sure a detection of each is.
MENTION, NAME, ADDRESS, GRANT, TEXT = 1, 2, 3, 4, 5
CONFIDENCE = {MENTION: 0.5, NAME: 0.8, ADDRESS: 0.9, GRANT: 0.95, TEXT: 1.0}

#: Label and phrase of the base rules.
BASE = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

_LICENSE = "licen[cs]e"
_GRANT = (
    "(?:licensed|released|distributed|published|available|provided|offered|covered|issued|shared)"
    "(?: to you)?(?: under| by| according to| subject to)(?: the)?(?: terms(?: and conditions)? of)?(?: the)? "
)


def _version(*numbers: str) -> str:
    """A version with or without its word, as ``version 2 0``, ``v2`` or ``2 0``."""
    first, *rest = numbers
    tail = "".join(f" {n}" for n in rest)
    return f"(?: version| ver| v)?(?: v?{first}{f'(?:{tail})?' if rest == ['0'] else tail})"


#: Label, keyword, name, SPDX words, words of the address.
_NAMED = (
    ("0bsd", "bsd", f"(?:zero clause|0 clause) bsd(?: {_LICENSE})?", "0bsd", "opensource org licenses 0bsd"),
    ("afl-3.0", "academic", f"academic free {_LICENSE}{_version('3', '0')}", "afl 3 0", "opensource org licenses afl 3 0"),
    ("agpl", "affero", f"(?:gnu )?affero general public {_LICENSE}", "agpl", "gnu org licenses agpl"),
    ("agpl-3.0", "affero", f"(?:gnu )?affero general public {_LICENSE}{_version('3', '0')}", "agpl 3 0", "gnu org licenses agpl 3 0"),
    ("apache", "apache", f"apache(?: software)? {_LICENSE}", "apache", "apache org licenses"),
    ("apache-1.1", "apache", f"apache(?: software)? {_LICENSE}{_version('1', '1')}", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-2.0", "apache", f"apache(?:(?: software)? {_LICENSE})?{_version('2', '0')}(?: {_LICENSE})?", "apache 2 0", "apache org licenses license 2 0"),
    ("apsl-2.0", "apple", f"apple public source {_LICENSE}", "apsl 2 0", "opensource apple com apsl"),
    ("artistic", "artistic", f"artistic {_LICENSE}", "artistic", "opensource org licenses artistic license"),
    ("artistic-1.0", "artistic", f"artistic {_LICENSE}{_version('1', '0')}", "artistic 1 0", "opensource org licenses artistic license 1 0"),
    ("artistic-2.0", "artistic", f"artistic {_LICENSE}{_version('2', '0')}", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("bsd", "bsd", f"bsd(?: style)? {_LICENSE}", "bsd", "opensource org licenses bsd license"),
    ("bsd-2-clause", "bsd", f"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: {_LICENSE})?", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", "bsd", f"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|new bsd|modified bsd|revised bsd)(?: {_LICENSE})?", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", "bsd", f"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd|old bsd)(?: {_LICENSE})?", "bsd 4 clause", "spdx org licenses bsd 4 clause"),
    ("bsl-1.0", "boost", f"boost(?: software)? {_LICENSE}", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", "business", f"business source {_LICENSE}", "busl 1 1", "mariadb com bsl11"),
    ("cc0-1.0", "cc0", f"cc0(?: 1 0)?(?: universal)?(?: {_LICENSE}| dedication)?", "cc0 1 0", "creativecommons org publicdomain zero 1 0"),
    ("cddl-1.0", "development", f"common development and distribution {_LICENSE}", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cecill", "cecill", f"cecill(?: free software)? {_LICENSE}", "cecill 2 1", "cecill info licences"),
    ("cpal-1.0", "attribution", f"common public attribution {_LICENSE}", "cpal 1 0", "opensource org licenses cpal 1 0"),
    ("cpl-1.0", "common", f"common public {_LICENSE}", "cpl 1 0", "opensource org licenses cpl 1 0"),
    ("ecl-2.0", "educational", f"educational community {_LICENSE}", "ecl 2 0", "opensource org licenses ecl 2 0"),
    ("elastic-2.0", "elastic", f"elastic {_LICENSE}", "elastic 2 0", "elastic co licensing elastic license"),
    ("epl-1.0", "eclipse", f"eclipse public {_LICENSE}{_version('1', '0')}", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse", f"eclipse public {_LICENSE}{_version('2', '0')}", "epl 2 0", "eclipse org legal epl 2 0"),
    ("epl", "eclipse", f"eclipse public {_LICENSE}", "epl", "eclipse org legal epl"),
    ("eupl-1.2", "european", f"european union public {_LICENSE}", "eupl 1 2", "joinup ec europa eu eupl"),
    ("gfdl", "documentation", f"(?:gnu )?free documentation {_LICENSE}", "gfdl 1 3", "gnu org licenses fdl"),
    ("gpl", "general", f"(?:gnu )?general public {_LICENSE}", "gpl", "gnu org licenses gpl"),
    ("gpl-1.0", "general", f"(?:gnu )?general public {_LICENSE}{_version('1', '0')}", "gpl 1 0", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", "general", f"(?:gnu )?general public {_LICENSE}{_version('2', '0')}", "gpl 2 0", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", "general", f"(?:gnu )?general public {_LICENSE}{_version('3', '0')}", "gpl 3 0", "gnu org licenses gpl 3 0"),
    ("hpnd", "historical", "historical permission notice and disclaimer", "hpnd", "opensource org licenses hpnd"),
    ("isc", "isc", f"isc {_LICENSE}", "isc", "opensource org licenses isc"),
    ("json", "json", f"json {_LICENSE}", "json", "json org license"),
    ("lgpl", "general", f"(?:gnu )?(?:lesser|library) general public {_LICENSE}", "lgpl", "gnu org licenses lgpl"),
    ("lgpl-2.1", "general", f"(?:gnu )?lesser general public {_LICENSE}{_version('2', '1')}", "lgpl 2 1", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", "general", f"(?:gnu )?lesser general public {_LICENSE}{_version('3', '0')}", "lgpl 3 0", "gnu org licenses lgpl 3 0"),
    ("libpng", "libpng", f"libpng {_LICENSE}", "libpng 2 0", "libpng org pub png src libpng license"),
    ("lppl-1.3c", "latex", f"latex project public {_LICENSE}", "lppl 1 3c", "latex project org lppl"),
    ("mit", "mit", f"(?:mit|expat|x11 mit|mit x11)(?: x11)? {_LICENSE}", "mit", "opensource org licenses mit"),
    ("mit-0", "mit", f"mit (?:0|no attribution)(?: {_LICENSE})?", "mit 0", "opensource org licenses mit 0"),
    ("mpl", "mozilla", f"mozilla public {_LICENSE}", "mpl", "mozilla org mpl"),
    ("mpl-1.1", "mozilla", f"mozilla public {_LICENSE}{_version('1', '1')}", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", "mozilla", f"mozilla public {_LICENSE}{_version('2', '0')}", "mpl 2 0", "mozilla org mpl 2 0"),
    ("ms-pl", "microsoft", f"microsoft public {_LICENSE}", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", "microsoft", f"microsoft reciprocal {_LICENSE}", "ms rl", "opensource org licenses ms rl"),
    ("ncsa", "illinois", f"university of illinois ncsa open source {_LICENSE}", "ncsa", "opensource org licenses ncsa"),
    ("odbl-1.0", "database", f"open database {_LICENSE}", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("odc-by-1.0", "commons", f"open data commons attribution {_LICENSE}", "odc by 1 0", "opendatacommons org licenses by"),
    ("ofl-1.1", "font", f"(?:sil )?open font {_LICENSE}", "ofl 1 1", "scripts sil org ofl"),
    ("openssl", "openssl", f"openssl {_LICENSE}", "openssl", "openssl org source license"),
    ("osl-3.0", "software", f"open software {_LICENSE}", "osl 3 0", "opensource org licenses osl 3 0"),
    ("parity-7.0", "parity", f"parity public {_LICENSE}", "parity 7 0 0", "paritylicense com"),
    ("php-3.01", "php", f"php {_LICENSE}", "php 3 01", "php net license"),
    ("polyform", "polyform", f"polyform (?:noncommercial|shield|strict|small business) {_LICENSE}", "polyform noncommercial 1 0 0", "polyformproject org licenses"),
    ("postgresql", "postgresql", f"postgresql {_LICENSE}", "postgresql", "opensource org licenses postgresql"),
    ("psf-2.0", "python", f"python(?: software foundation)? {_LICENSE}", "psf 2 0", "docs python org license"),
    ("qpl-1.0", "public", f"q public {_LICENSE}", "qpl 1 0", "opensource org licenses qpl 1 0"),
    ("rpl-1.5", "reciprocal", f"reciprocal public {_LICENSE}", "rpl 1 5", "opensource org licenses rpl 1 5"),
    ("ruby", "ruby", f"ruby {_LICENSE}", "ruby", "ruby lang org license"),
    ("sspl-1.0", "server", f"server side public {_LICENSE}", "sspl 1 0", "mongodb com licensing server side public license"),
    ("unlicense", "unlicense", "unlicen[cs]e", "unlicense", "unlicense org"),
    ("upl-1.0", "universal", f"universal permissive {_LICENSE}", "upl 1 0", "opensource org licenses upl"),
    ("vim", "vim", f"vim {_LICENSE}", "vim", "vimhelp org license"),
    ("wtfpl", "wtfpl", f"wtfpl(?: {_LICENSE})?", "wtfpl", "wtfpl net"),
    ("x11", "x11", f"x11 {_LICENSE}", "x11", "spdx org licenses x11"),
    ("zlib", "zlib", f"zlib(?: libpng)? {_LICENSE}", "zlib", "zlib net zlib license"),
    ("zpl-2.1", "zope", f"zope public {_LICENSE}", "zpl 2 1", "opensource org licenses zpl 2 1"),
)

#: Parts of the public licenses for creative work, and their versions.
_PARTS = (("by", "attribution"), ("by sa", "attribution share ?alike"), ("by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
          ("by nc", "attribution non ?commercial"), ("by nc sa", "attribution non ?commercial share ?alike"),
          ("by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"))
_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")

#: Label, stem, keyword and pattern of sentences that stand in the licenses themselves or in notices.
_SENTENCES = (
    ("mit", "permission", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "copyright", "notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "warrant", "kind", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("isc", "permission", "fee", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("hpnd", "permission", "documentation", "permission to use copy modify and distribute this software and its documentation for any purpose"),
    ("bsd", "redistribut", "binary", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistribut", "retain", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistribut", "reproduce", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "permission", "contributors", "neither the names? of(?: [^ ]+){1,12} nor the names of(?: its| their| any)? contributors may be used to endorse or promote products(?: [^ ]+){0,8} without specific prior written permission"),
    ("bsd-4-clause", "advertising", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "licen", "compliance", f"you may not use this file except in compliance with the {_LICENSE}"),
    ("apache-2.0", "licen", "perpetual", f"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright {_LICENSE}"),
    ("gpl", "redistribut", "free", f"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public {_LICENSE}"),
    ("lgpl", "redistribut", "lesser", f"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu lesser general public {_LICENSE}"),
    ("agpl", "redistribut", "affero", f"this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public {_LICENSE}"),
    ("gpl-2.0-or-later", "licen", "option", f"either version 2 of the {_LICENSE} or at your option any later version"),
    ("gpl-3.0-or-later", "licen", "option", f"either version 3 of the {_LICENSE} or at your option any later version"),
    ("gpl", "licen", "received", f"you should have received a copy of the gnu general public {_LICENSE}"),
    ("lgpl", "licen", "received", f"you should have received a copy of the gnu lesser general public {_LICENSE}"),
    ("agpl", "licen", "received", f"you should have received a copy of the gnu affero general public {_LICENSE}"),
    ("gpl", "copyleft", "copyleft", f"copyleft {_LICENSE} for software and other kinds of works"),
    ("mpl-2.0", "licen", "mozilla", f"this source code form is subject to the terms of the mozilla public {_LICENSE} v 2 0"),
    ("mpl-1.1", "licen", "mozilla", f"the contents of this file are subject to the mozilla public {_LICENSE} version 1 1"),
    ("unlicense", "domain", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "copyright", "waived", "has waived all copyright and related or neighbou?ring rights to"),
    ("public-domain", "domain", "public", "(?:released|placed|dedicated|put)(?: in| into| to) the public domain"),
    ("public-domain", "domain", "public", "(?:this|the) (?:work|text|document|file|software|code|page|material) is in the public domain"),
    ("wtfpl", "licen", "want", "do what the fuck you want to public licen[cs]e"),
    ("zlib", "altered", "altered", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("json", "evil", "evil", "the software shall be used for good not evil"),
    ("bsl-1.0", "licen", "boost", f"boost software {_LICENSE} version 1 0 august 17th 2003"),
    ("ofl-1.1", "font", "font", "the font software may be modified altered or added to"),
    ("openssl", "openssl", "openssl", "this product includes software developed by the openssl project"),
    ("gfdl", "documentation", "documentation", f"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation {_LICENSE}"),
    ("proprietary", "reserved", "rights", "all rights(?: are)? reserved"),
    ("proprietary", "confidential", "proprietary", "(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "permission", "written", "may not be (?:reproduced|copied|distributed|used)(?: [^ ]+){0,8} without(?: the)?(?: express)?(?: prior)? written permission"),
    ("non-commercial", "licen", "only", f"licen[cs]ed for (?:non commercial|noncommercial|personal|academic|research)(?: [^ ]+)? use only(?: {_LICENSE})?"),
)


def _rules() -> tuple[Rule, ...]:
    out = [Rule(label, TEXT, stem, keyword, pattern) for label, stem, keyword, pattern in _SENTENCES]
    for label, keyword, name, spdx, address in _NAMED:
        stem = {"hpnd": "permission", "wtfpl": "wtfpl", "unlicense": "unlicen", "cc0-1.0": "cc0", "0bsd": "bsd", "bsd-2-clause": "bsd", "bsd-3-clause": "bsd",
                "bsd-4-clause": "bsd", "mit-0": "mit (?:0|no)", "apache-2.0": "apache"}.get(label, "licen")
        alone = keyword if keyword in name and "|expat" not in name else ""
        out.append(Rule(label, TEXT, "spdx", "spdx", f"spdx licen[cs]e identifier {spdx}(?: only| or later)?"))
        out.append(Rule(label, GRANT, stem, alone, _GRANT + name))
        out.append(Rule(label, ADDRESS, address.split(" ")[0], address.split(" ")[0], address))
        out.append(Rule(label, NAME, stem, alone, name))
    for short, long_ in _PARTS:
        for version in ("", *_VERSIONS):
            label = "-".join(["cc", *short.split(" "), *([version.replace(" ", ".")] if version else [])])
            after = f" {version}" if version else ""
            words = f"cc {short}{after}"
            spoken = f"creative commons {long_}(?: {version}|{f' {version}'} international| version {version})" if version else f"creative commons {long_}"
            out.append(Rule(label, TEXT, "spdx", "spdx", f"spdx licen[cs]e identifier {words}"))
            out.append(Rule(label, GRANT, "cc by", "cc", f"{_GRANT}(?:a )?{words}(?: {_LICENSE})?"))
            out.append(Rule(label, NAME, "cc by", "cc", f"{words}(?: {_LICENSE})?"))
            out.append(Rule(label, GRANT, "creative", "commons", f"{_GRANT}(?:a )?{spoken}(?: international)?(?: {_LICENSE})?"))
            out.append(Rule(label, NAME, "creative", "commons", f"{spoken}(?: international)?(?: {_LICENSE})?"))
            out.append(Rule(label, ADDRESS, "creativecommons", "creativecommons", f"creativecommons org licenses {short}{after}"))
    for label, keyword in (("gpl", "gpl"), ("lgpl", "lgpl"), ("agpl", "agpl"), ("mpl", "mpl"), ("epl", "epl"), ("cddl", "cddl"), ("eupl", "eupl")):
        for version in ("", "1", "2", "2 1", "3"):
            number = version.replace(" ", ".")
            full = f"-{number if '.' in number else number + '.0'}" if version else ""
            name = f"(?:gnu )?{keyword}" + (f"(?: version| v)? v?{version}(?: 0)?" if version else "")
            out.append(Rule(label + full, GRANT, keyword, keyword, _GRANT + name))
            out.append(Rule(label + full, MENTION, keyword, keyword, f"{name} {_LICENSE}"))
    return tuple(out)


RULES = _rules()
