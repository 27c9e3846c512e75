"""Signature rules for licenses: families written by hand, each with the forms in which it is cited.

Patterns are regular expressions over words: lower case, one blank between words, dots and hyphens gone, so
"Apache License, Version 2.0" is `apache license version 2 0`. They use alternatives, groups, `?` and
character classes only, which mean the same to Python and to RE2.

A rule has a keyword, which every match holds, so that a text without it need not be searched.
Rules are ordered. A smaller level comes first, and within a level the order of the list counts.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str
    pattern: str
    level: int
    confidence: float


class Family(NamedTuple):
    """A license: its words in an SPDX id, its name, the word that every form holds, its versions.

    `keyword` is in all of its forms but the address. `short` is how it is cited with a version but without
    its name; `named` is false if the name alone does not count.
    """

    label: str
    keyword: str
    name: str
    versions: str = ""
    short: str = ""
    url: str = ""
    named: bool = True


LICENSE = "licen[cs]e"

# Names, versions and addresses of licenses.
FAMILIES = [
    Family("gpl", "gnu", f"gnu( general)? public {LICENSE}", "1.0 2.0 3.0", "gnu gpl", "gnu org licenses( old licenses)? gpl"),
    Family("gpl", "gpl", "gpl", "1.0 2.0 3.0", "gpl", named=False),
    Family("lgpl", "gnu", f"gnu (lesser|library) general public {LICENSE}", "2.0 2.1 3.0", "gnu lgpl", "gnu org licenses( old licenses)? lgpl"),
    Family("lgpl", "lgpl", "lgpl", "2.0 2.1 3.0", "lgpl", named=False),
    Family("agpl", "affero", f"(gnu )?affero general public {LICENSE}", "1.0 3.0"),
    Family("agpl", "agpl", "agpl", "1.0 3.0", "agpl", "gnu org licenses agpl", named=False),
    Family("gfdl", "documentation", f"gnu free documentation {LICENSE}", "1.1 1.2 1.3"),
    Family("gfdl", "gfdl", "gfdl", "1.1 1.2 1.3", "gfdl", named=False),
    Family("apache", "apache", f"apache( software)? {LICENSE}", "1.0 1.1 2.0", "apache", "apache org licenses license"),
    Family("mit", "mit", f"mit {LICENSE}", url="opensource org licenses mit"),
    Family("mit-0", "attribution", f"mit no attribution( {LICENSE})?"),
    Family("x11", "x11", f"x11 {LICENSE}"),
    Family("mit", "expat", f"expat {LICENSE}"),
    Family("bsd", "bsd", f"bsd {LICENSE}"),
    Family("0bsd", "bsd", f"(zero clause bsd|bsd zero clause|bsd 0 clause|0 clause bsd)( {LICENSE})?"),
    Family("0bsd", "0bsd", f"0bsd( {LICENSE})?"),
    Family("bsd-1-clause", "bsd", f"(bsd 1 clause|1 clause bsd)( {LICENSE})?"),
    Family("bsd-2-clause", "bsd", f"(bsd 2 clause|(2|two) clause bsd|simplified bsd|freebsd bsd)( {LICENSE})?"),
    Family("bsd-3-clause", "bsd", f"(bsd 3 clause|(3|three) clause bsd|(new|modified|revised) bsd)( {LICENSE})?"),
    Family("bsd-4-clause", "bsd", f"(bsd 4 clause|(4|four) clause bsd|original bsd)( {LICENSE})?"),
    Family("isc", "isc", f"isc {LICENSE}"),
    Family("zlib", "zlib", f"zlib( libpng)? {LICENSE}"),
    Family("libpng", "libpng", f"libpng {LICENSE}", "2.0"),
    Family("unlicense", "unlicense", "(the )?unlicense", url="unlicense org"),
    Family("wtfpl", "wtfpl", f"wtfpl( {LICENSE})?", "1.0 2.0"),
    Family("boost", "boost", f"boost software {LICENSE}", "1.0", "boost", "boost org license 1 0"),
    Family("mpl", "mozilla", f"mozilla public {LICENSE}", "1.0 1.1 2.0", "", "mozilla org (en us )?mpl"),
    Family("mpl", "mpl", "mpl", "1.0 1.1 2.0", "mpl", named=False),
    Family("epl", "eclipse", f"eclipse public {LICENSE}", "1.0 2.0", "", "eclipse org legal epl"),
    Family("epl", "epl", "epl", "1.0 2.0", "epl", named=False),
    Family("edl", "eclipse", f"eclipse distribution {LICENSE}", "1.0"),
    Family("cddl", "distribution", f"common development and distribution {LICENSE}", "1.0 1.1"),
    Family("cddl", "cddl", "cddl", "1.0 1.1", "cddl", named=False),
    Family("eupl", "european", f"european union public {LICENSE}", "1.0 1.1 1.2"),
    Family("eupl", "eupl", "eupl", "1.0 1.1 1.2", "eupl"),
    Family("cecill", "cecill", f"cecill( free software)?( {LICENSE}( agreement)?)?", "1.0 1.1 2.0 2.1"),
    Family("cecill-b", "cecill", f"cecill b( {LICENSE})?"),
    Family("cecill-c", "cecill", f"cecill c( {LICENSE})?"),
    Family("artistic", "artistic", f"(perl )?artistic {LICENSE}", "1.0 2.0"),
    Family("osl", "open", f"open software {LICENSE}", "1.0 1.1 2.0 2.1 3.0"),
    Family("afl", "academic", f"academic free {LICENSE}", "1.1 1.2 2.0 2.1 3.0"),
    Family("ms-pl", "microsoft", f"microsoft public {LICENSE}"),
    Family("ms-rl", "microsoft", f"microsoft reciprocal {LICENSE}"),
    Family("psf", "python", f"python( software foundation)? {LICENSE}", "2.0"),
    Family("ruby", "ruby", f"ruby {LICENSE}"),
    Family("php", "php", f"php {LICENSE}", "3.0"),
    Family("postgresql", "postgresql", f"postgresql {LICENSE}"),
    Family("openssl", "openssl", f"openssl {LICENSE}"),
    Family("sleepycat", "sleepycat", f"sleepycat {LICENSE}"),
    Family("w3c", "w3c", f"w3c software( notice and)? {LICENSE}"),
    Family("ofl", "font", f"(sil )?open font {LICENSE}", "1.0 1.1"),
    Family("ofl", "ofl", "ofl", "1.0 1.1", "ofl", "scripts sil org ofl", named=False),
    Family("ncsa", "ncsa", f"(university of illinois )?ncsa( open source)? {LICENSE}"),
    Family("upl", "universal", f"universal permissive {LICENSE}", "1.0"),
    Family("busl", "business", f"business source {LICENSE}", "1.1"),
    Family("sspl", "server", f"server side public {LICENSE}", "1.0"),
    Family("elastic", "elastic", f"elastic {LICENSE}", "1.0 2.0"),
    Family("odbl", "database", f"open( data commons)?( open)? database {LICENSE}", "1.0"),
    Family("odbl", "odbl", "odbl", "1.0", "odbl", "opendatacommons org licenses odbl"),
    Family("odc-by", "commons", f"open data commons attribution {LICENSE}", "1.0"),
    Family("pddl", "public", f"public domain dedication and {LICENSE}", "1.0"),
    Family("cdla-permissive", "community", f"community data {LICENSE} agreement permissive", "1.0 2.0"),
    Family("cdla-sharing", "community", f"community data {LICENSE} agreement sharing", "1.0"),
    Family("openrail", "openrail", f"(creativeml )?openrail( m)?( {LICENSE})?"),
    Family("llama", "community", f"llama( [234]| [234] [0-9])? community {LICENSE}( agreement)?"),
    Family("beerware", "beerware", f"beerware( {LICENSE})?"),
    Family("vim", "vim", f"vim {LICENSE}"),
    Family("tcl", "tcl", f"tcl( tk)? {LICENSE}"),
    Family("json", "json", f"json {LICENSE}"),
    Family("curl", "curl", f"curl {LICENSE}"),
    Family("icu", "icu", f"icu {LICENSE}"),
    Family("unicode", "unicode", f"unicode( data files and software)? {LICENSE}( agreement)?"),
    Family("nasa", "nasa", "nasa open source agreement", "1.3"),
    Family("ipl", "ibm", f"ibm public {LICENSE}", "1.0"),
    Family("cpl", "common", f"common public {LICENSE}", "1.0"),
    Family("cpal", "common", f"common public attribution {LICENSE}", "1.0"),
    Family("apsl", "apple", f"apple public source {LICENSE}", "1.0 1.1 1.2 2.0"),
    Family("qpl", "q public", f"q public {LICENSE}", "1.0"),
    Family("lppl", "latex", f"latex project public {LICENSE}", "1.0 1.1 1.2 1.3"),
    Family("lppl", "lppl", "lppl", "1.0 1.1 1.2 1.3", "lppl", named=False),
    Family("zpl", "zope", f"zope public {LICENSE}", "1.1 2.0 2.1"),
    Family("ecl", "educational", f"educational community {LICENSE}", "1.0 2.0"),
    Family("rpl", "reciprocal", f"reciprocal public {LICENSE}", "1.1 1.5"),
    Family("mulan", "mulan", f"mulan (permissive|psl)( software)? {LICENSE}", "1.0 2.0"),
    Family("oldap", "openldap", f"openldap public {LICENSE}", "2.8"),
    Family("intel", "intel", f"intel (open source|simplified software) {LICENSE}"),
    Family("cc0", "cc0", "cc0", "1.0", "cc0"),
    Family("cc0", "creative", "creative commons zero", "1.0", "", "creativecommons org publicdomain zero"),
]

# The parts of the Creative Commons licenses and their versions.
COMMONS = {
    "cc-by": ("by", "attribution"),
    "cc-by-sa": ("by sa", "attribution share( )?alike"),
    "cc-by-nd": ("by nd", "attribution no( )?deriv(s|ative|atives)"),
    "cc-by-nc": ("by nc", "attribution non( )?commercial"),
    "cc-by-nc-sa": ("by nc sa", "attribution non( )?commercial share( )?alike"),
    "cc-by-nc-nd": ("by nc nd", "attribution non( )?commercial no( )?deriv(s|ative|atives)"),
}
COMMONS_VERSIONS = "1.0 2.0 2.5 3.0 4.0"

# Sentences of the texts of licenses.
SENTENCES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("isc", "permission", "permission to use copy modify( and or|and| or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "altered", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain"),
    ("gpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu general public {LICENSE}"),
    ("lgpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public {LICENSE}"),
    ("agpl", "redistribute", f"you can redistribute it and or modify it under the terms of the gnu affero general public {LICENSE}"),
    ("apache-2.0", "compliance", f"you may not use this file except in compliance with the {LICENSE}"),
    ("mpl-2.0", "mozilla", f"this source code form is subject to the terms of the mozilla public {LICENSE}"),
    ("boost-1.0", "boost", f"distributed under the boost software {LICENSE}"),
    ("wtfpl", "want", "do what the fuck you want to public license"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("public-domain", "public", "(released|dedicated|placed) (into|to|in) the public domain"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
]

# Forms by how much they say: 0 tags and sentences, 1 grants, 2 names with a version and addresses, 3 names.
TAG, GRANT, VERSION, NAME = range(4)
CONFIDENCE = {TAG: 1.0, GRANT: 0.95, VERSION: 0.9, NAME: 0.7}

UNDER = "(licen[cs]ed|released|distributed|available|published|covered) under( the)?( terms of)?( the)?"


def _number(version: str, before: str = "(version |ver |v )?v?") -> str:
    """`2.0` as words: 2, 2 0, v2 0, version 2 0."""
    major, minor = version.split(".")
    return f"{before}{major}" + ("( 0)?" if minor == "0" else f" {minor}")


def _tagged(label: str, keyword: str, words: str) -> Rule:
    return Rule(label, keyword, f"spdx license identifier {words}( only| or later)?", TAG, CONFIDENCE[TAG])


def _family_rules(family: Family) -> list[Rule]:
    rules = []

    def add(label: str, pattern: str, level: int, keyword: str = family.keyword) -> None:
        rules.append(Rule(label, keyword, pattern, level, CONFIDENCE[level]))

    for version in family.versions.split():
        label, number = f"{family.label}-{version}", _number(version)
        tag = family.label.replace("-", " ")
        rules.append(_tagged(label, "spdx", f"{tag} {number}"))
        add(label, f"{UNDER} {family.name} {number}", GRANT)
        add(label, f"{family.name} {number}", VERSION)
        if family.short:  # gpl 3, gpl version 3, gplv3
            add(label, f"{family.short}( {_number(version)}|{_number(version, 'v?')})", VERSION)
        if family.url:
            add(label, f"{family.url} v?{version.replace('.', ' ')}", VERSION, family.url.split()[0])
    if not family.versions:
        rules.append(_tagged(family.label, "spdx", family.label.replace("-", " ")))
        if family.url:
            add(family.label, family.url, VERSION, family.url.split()[0])
    add(family.label, f"{UNDER} {family.name}", GRANT)
    if family.named:
        add(family.label, family.name, NAME)
    return rules


def _commons_rules() -> list[Rule]:
    rules = []
    for label, (short, long) in COMMONS.items():
        for version in COMMONS_VERSIONS.split():
            number = _number(version)
            rules += [
                _tagged(f"{label}-{version}", "spdx", f"cc {short} {number}"),
                Rule(f"{label}-{version}", "cc", f"cc {short} {number}", VERSION, CONFIDENCE[VERSION]),
                Rule(f"{label}-{version}", "creative", f"creative commons {long}( {version.replace('.', ' ')})?( international| unported)? {LICENSE} {number}", VERSION, CONFIDENCE[VERSION]),
                Rule(f"{label}-{version}", "creative", f"creative commons {long} {number}", VERSION, CONFIDENCE[VERSION]),
                Rule(f"{label}-{version}", "creativecommons", f"creativecommons org licenses {short} {version.replace('.', ' ')}", VERSION, CONFIDENCE[VERSION]),
            ]
        rules.append(Rule(label, "cc", f"cc {short}", NAME, CONFIDENCE[NAME]))
        rules.append(Rule(label, "creative", f"creative commons {long}( {LICENSE})?", NAME, CONFIDENCE[NAME]))
    return rules


def signature_rules() -> list[Rule]:
    """All rules, those of smaller levels first."""
    rules = [Rule(label, keyword, pattern, TAG, CONFIDENCE[TAG]) for label, keyword, pattern in SENTENCES]
    for family in FAMILIES:
        rules += _family_rules(family)
    rules += _commons_rules()
    # forms that two families share count once
    return sorted({(r.label, r.pattern): r for r in reversed(rules)}.values(), key=lambda r: (r.level, r.label, r.pattern))
