"""Signature rules of the license scan: (label, priority, keyword, pattern).

Patterns are over normalised text: lower-case words with one space between them, a space before the first and
after the last. A pattern begins at the space before its first word and ends before the space after its last.
A rule is tried on a text only if the text has the rule's keyword, which stands in whatever the pattern matches and
holds no space. Priorities: 1 identifiers and addresses,
2 full names with a version, 3 full names, 4 grants by name, 5 clauses of a license's body, 6 general notices.
"""

from __future__ import annotations

END = r"(?= )"
V = r"(?: v| ver| version)?"


def _creative_commons():
    kinds = {"by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s?", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s?"}
    for kind, name in kinds.items():
        tag = "cc-" + kind.replace(" ", "-")
        for major in ("1", "2", "2.5", "3", "4"):
            number = major.replace(".", " ") + ("" if "." in major else " 0")
            label = f"{tag}-{major if '.' in major else major + '.0'}"
            yield label, 1, "cc", rf" cc {kind} {number}"
            yield label, 1, "creativecommons", rf" creativecommons org licenses {kind} {number}"
            yield label, 2, "creative", rf" creative commons {name}(?: (?:international|unported|generic))?(?: license)?{V} {number}"
        yield tag, 3, "cc", rf" cc {kind}"
        yield tag, 3, "creative", rf" creative commons {name}(?: license)?"
    yield "cc0-1.0", 1, "cc0", r" cc0(?: 1 0)?"
    yield "cc0-1.0", 1, "creativecommons", r" creativecommons org publicdomain zero 1 0"
    yield "cc0-1.0", 2, "creative", r" creative commons (?:zero|cc0)(?: 1 0)?"
    yield "cc-pdm-1.0", 1, "creativecommons", r" creativecommons org publicdomain mark 1 0"
    yield "cc-unspecified", 6, "creative", r" creative commons(?: public)? license"


def _gnu():
    for tag, name, versions in (("agpl", "affero general public license", ("1", "3")), ("lgpl", "(?:lesser|library) general public license", ("2", "2.1", "3")), ("gpl", "general public license", ("1", "2", "3"))):
        for v in versions:
            number = v.replace(".", " ") + (r"(?: 0)?" if "." not in v else "")
            label = f"{tag}-{v if '.' in v else v + '.0'}"
            later = r" or(?: \(?at your option\)?)?(?: any)? later(?: version)?"
            yield f"{label}-or-later", 2, "license", rf" (?:gnu )?{name}{V} {number}{later}"
            yield f"{label}-or-later", 1, tag, rf" {tag}{V} ?{number}(?:{later}| or later|\+)"
            yield f"{label}-only", 1, tag, rf" {tag}{V} ?{number} only"
            yield label, 2, "license", rf" (?:gnu )?{name}{V} {number}"
            yield label, 1, tag, rf" {tag}{V} {number}"
            yield label, 1, tag, rf" {tag}v{number}"
        yield tag, 3, "license", rf" gnu {name}"
        yield tag, 4, tag, rf" (?:under|by) the (?:gnu )?{tag}"
    yield "gfdl-1.3", 2, "documentation", r" gnu free documentation license(?: v| version)? 1 3"
    yield "gfdl-1.2", 2, "documentation", r" gnu free documentation license(?: v| version)? 1 2"
    yield "gfdl", 3, "documentation", r" (?:gnu )?free documentation license"


HAND = (
    ("mit", 1, "spdx", r" spdx license identifier mit"),
    ("mit", 2, "mit", r" the mit license"),
    ("mit", 3, "mit", r" mit license"),
    ("mit", 4, "mit", r" (?:licensed|released|available|distributed) under (?:the )?mit"),
    ("mit", 5, "permission", r" permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 5, "permission", r" the above copyright notice and this permission notice shall be included in all copies"),
    ("x11", 3, "x11", r" x11 license"),
    ("isc", 3, "isc", r" isc license"),
    ("isc", 5, "permission", r" permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("apache-2.0", 1, "spdx", r" spdx license identifier apache 2 0"),
    ("apache-2.0", 1, "apache", r" www apache org licenses license 2 0"),
    ("apache-2.0", 2, "apache", r" apache(?: software)? license(?: v| version)? 2(?: 0)?"),
    ("apache-2.0", 4, "apache", r" (?:licensed|released) under (?:the )?apache 2(?: 0)?"),
    ("apache-1.1", 2, "apache", r" apache(?: software)? license(?: v| version)? 1 1"),
    ("apache-1.0", 2, "apache", r" apache(?: software)? license(?: v| version)? 1 0"),
    ("apache", 3, "apache", r" apache(?: software)? license"),
    ("bsd-2-clause", 1, "spdx", r" spdx license identifier bsd 2 clause"),
    ("bsd-3-clause", 1, "spdx", r" spdx license identifier bsd 3 clause"),
    ("bsd-2-clause", 2, "bsd", r" (?:simplified|2 clause|two clause|freebsd) bsd(?: license)?"),
    ("bsd-2-clause", 2, "bsd", r" bsd(?: license)? (?:2|two) clause"),
    ("bsd-3-clause", 2, "bsd", r" (?:new|modified|revised|3 clause|three clause) bsd(?: license)?"),
    ("bsd-3-clause", 2, "bsd", r" bsd(?: license)? (?:3|three) clause"),
    ("bsd-4-clause", 2, "bsd", r" (?:original|4 clause) bsd(?: license)?"),
    ("0bsd", 1, "0bsd", r" 0bsd"),
    ("0bsd", 2, "bsd", r" (?:zero clause|0 clause) bsd"),
    ("bsd", 3, "bsd", r" bsd(?: style)? license"),
    ("bsd", 4, "bsd", r" (?:licensed|released) under (?:the |a )?bsd"),
    ("bsd", 5, "redistribution", r" redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 5, "endorse", r" may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2.0", 1, "mozilla", r" mozilla org mpl 2 0"),
    ("mpl-2.0", 2, "mozilla", r" mozilla public license(?: v| version)? 2(?: 0)?"),
    ("mpl-1.1", 2, "mozilla", r" mozilla public license(?: v| version)? 1 1"),
    ("mpl-1.0", 2, "mozilla", r" mozilla public license(?: v| version)? 1 0"),
    ("mpl", 3, "mozilla", r" mozilla public license"),
    ("mpl-2.0", 1, "mpl", r" mpl 2 0"),
    ("epl-2.0", 2, "eclipse", r" eclipse public license(?: v| version)? 2(?: 0)?"),
    ("epl-1.0", 2, "eclipse", r" eclipse public license(?: v| version)? 1(?: 0)?"),
    ("epl", 3, "eclipse", r" eclipse public license"),
    ("edl-1.0", 2, "eclipse", r" eclipse distribution license(?: v| version)? 1 0"),
    ("cpl-1.0", 2, "common", r" common public license(?: v| version)? 1 0"),
    ("cpl", 3, "common", r" common public license"),
    ("cddl-1.0", 2, "common", r" common development and distribution license(?: v| version)? 1 0"),
    ("cddl-1.1", 2, "common", r" common development and distribution license(?: v| version)? 1 1"),
    ("cddl", 3, "common", r" common development and distribution license"),
    ("eupl-1.2", 2, "european", r" european union public licen[cs]e(?: v| version)? 1 2"),
    ("eupl-1.1", 2, "european", r" european union public licen[cs]e(?: v| version)? 1 1"),
    ("eupl", 3, "european", r" european union public licen[cs]e"),
    ("artistic-2.0", 2, "artistic", r" artistic license(?: v| version)? 2(?: 0)?"),
    ("artistic-1.0", 2, "artistic", r" artistic license(?: v| version)? 1(?: 0)?"),
    ("artistic", 3, "artistic", r" artistic license"),
    ("zlib", 3, "zlib", r" zlib(?: libpng)? license"),
    ("zlib", 5, "altered", r" altered source versions must be plainly marked as such"),
    ("libpng", 3, "libpng", r" libpng license"),
    ("bsl-1.0", 2, "boost", r" boost software license(?: v| version)? 1 0"),
    ("bsl-1.0", 3, "boost", r" boost software license"),
    ("unlicense", 1, "unlicense", r" unlicense org"),
    ("unlicense", 3, "unlicense", r" the unlicense"),
    ("unlicense", 5, "unencumbered", r" this is free and unencumbered software released into the public domain"),
    ("wtfpl", 1, "wtfpl", r" wtfpl"),
    ("wtfpl", 3, "public", r" do what the f\w+ you want to public license"),
    ("afl-3.0", 2, "academic", r" academic free license(?: v| version)? 3 0"),
    ("afl", 3, "academic", r" academic free license"),
    ("osl-3.0", 2, "open", r" open software license(?: v| version)? 3 0"),
    ("osl", 3, "open", r" open software license"),
    ("ofl-1.1", 2, "sil", r" sil open font license(?: v| version)? 1 1"),
    ("ofl", 3, "font", r" (?:sil )?open font license"),
    ("odbl-1.0", 2, "database", r" open(?: data commons)? database license(?: v| version)? 1 0"),
    ("odbl", 3, "database", r" open(?: data commons)? database license"),
    ("odc-by", 3, "commons", r" open data commons attribution license"),
    ("pddl", 3, "public", r" open data commons public domain dedication(?: and license)?"),
    ("ogl-uk-3.0", 2, "government", r" open government licen[cs]e(?: v| version)? 3(?: 0)?"),
    ("ogl-uk", 3, "government", r" open government licen[cs]e"),
    ("cdla-permissive", 3, "community", r" community data license agreement permissive"),
    ("cdla-sharing", 3, "community", r" community data license agreement sharing"),
    ("psf-2.0", 2, "python", r" python software foundation license(?: v| version)? 2"),
    ("psf", 3, "python", r" python software foundation license"),
    ("php-3.01", 2, "php", r" php license(?: v| version)? 3 01"),
    ("php", 3, "php", r" the php license"),
    ("ruby", 3, "ruby", r" ruby license"),
    ("perl", 4, "perl", r" under the same terms as perl itself"),
    ("openssl", 3, "openssl", r" openssl license"),
    ("ms-pl", 3, "microsoft", r" microsoft public license"),
    ("ms-rl", 3, "microsoft", r" microsoft reciprocal license"),
    ("upl-1.0", 3, "universal", r" universal permissive license"),
    ("ncsa", 3, "illinois", r" university of illinois ncsa open source license"),
    ("w3c", 3, "w3c", r" w3c software(?: notice and)? license"),
    ("blueoak-1.0.0", 3, "oak", r" blue oak model license"),
    ("busl-1.1", 2, "business", r" business source license 1 1"),
    ("busl", 3, "business", r" business source license"),
    ("sspl-1.0", 3, "server", r" server side public license"),
    ("elastic-2.0", 2, "elastic", r" elastic license(?: v| version)? 2(?: 0)?"),
    ("polyform", 3, "polyform", r" polyform (?:noncommercial|shield|strict|small business) license"),
    ("commons-clause", 3, "commons", r" commons clause license condition"),
    ("rail", 3, "responsible", r" (?:open )?responsible ai license"),
    ("proprietary", 3, "proprietary", r" proprietary (?:and confidential|license|software)"),
    ("proprietary", 4, "license", r" (?:commercial|end user) license agreement"),
    ("proprietary", 4, "reproduced", r" no part of this (?:publication|work|book|document) may be reproduced"),
    ("proprietary", 4, "permission", r" (?:used|reprinted|reproduced) (?:with|by) permission"),
    ("proprietary", 5, "permission", r" without the (?:prior|express)(?: written)? permission of"),
    ("reserved", 6, "reserved", r" all rights reserved"),
    ("reserved", 6, "reserved", r" some rights reserved"),
    ("public-domain", 3, "public", r" (?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 6, "public", r" in the public domain"),
    ("warranty-disclaimer", 5, "warrant", r" provided as is without warranty of any kind"),
    ("warranty-disclaimer", 6, "warrant", r" without warranties or conditions of any kind"),
    ("copyright", 6, "copyright", r" copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("copyleft", 6, "copyleft", r" copyleft"),
    ("free-software", 5, "free", r" this program is free software you can redistribute it and or modify it"),
    ("spdx", 6, "spdx", r" spdx license identifier"),
)

RULES = (*_creative_commons(), *_gnu(), *HAND)
