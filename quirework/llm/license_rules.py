"""Signature rules of the license scan, in priority order.

A family is a license with its label, its keyword (one of several, parted by ``|``, that every match of its
name holds), and regexes for its name, its SPDX identifier and its
address. Forms are hand-written sentences around a name. A rule is one form for one family; rules of
earlier forms have priority, and so have earlier families within a form.
"""

# Label, keyword, name, SPDX identifier, address.
FAMILIES = [
    ("agpl", "affero|agpl", r"(?:gnu )?(?:affero general public licen[sc]e|agpl)(?:,?[\s-]*(?:version|v\.?)?\s*[13](?:\.0)?)?(?:\+|-only|-or-later)?", r"agpl-[13]\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("lgpl", "lesser|lgpl", r"(?:gnu )?(?:lesser general public licen[sc]e|lgpl)(?:,?[\s-]*(?:version|v\.?)?\s*[23](?:\.[01])?)?(?:\+|-only|-or-later)?", r"lgpl-(?:2\.0|2\.1|3\.0)(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e", r"lgpl-2\.0", r"gnu\.org/licenses/old-licenses/lgpl-2\.0"),
    ("gpl-3", "general|gpl", r"(?:gnu )?(?:general public licen[sc]e|(?<![a-z])gpl),?[\s-]*(?:version|v\.?)?\s*3(?:\.0)?(?:\+|-only|-or-later)?(?!\.?\d)", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3\.0"),
    ("gpl-2", "general|gpl", r"(?:gnu )?(?:general public licen[sc]e|(?<![a-z])gpl),?[\s-]*(?:version|v\.?)?\s*2(?:\.0)?(?:\+|-only|-or-later)?(?!\.?\d)", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/old-licenses/gpl-2\.0"),
    ("gpl", "general|gpl", r"(?:gnu )?(?:general public licen[sc]e|(?<![a-z])gpl)(?!\w)", r"gpl-1\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", r"gfdl-1\.[123](?:-[a-z-]+)?", r"gnu\.org/(?:licenses|copyleft)/fdl"),
    ("apache-2", "apache", r"apache(?:[\s-]+(?:software )?licen[sc]e)?,?[\s-]*(?:version|v\.?)?\s*2(?:\.0)?(?!\.?\d)", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("apache-1", "apache", r"apache(?:[\s-]+(?:software )?licen[sc]e),?[\s-]*(?:version|v\.?)?\s*1\.[01]", r"apache-1\.[01]", r"apache\.org/licenses/license-1\.[01]"),
    ("apache", "apache", r"apache (?:software )?licen[sc]e", r"apache", r"apache\.org/licenses"),
    ("mit", "mit|expat|x11", r"(?:mit|expat|x11)[ -](?:\(expat\) )?licen[sc]ed?", r"mit(?:-0)?", r"opensource\.org/licenses/mit"),
    ("bsd-2", "bsd", r"(?:2[ -]clause|two[ -]clause|simplified|freebsd) bsd(?: licen[sc]e)?|bsd[ -](?:2|two)[ -]clause(?: licen[sc]e)?", r"bsd-2-clause", r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3", "bsd", r"(?:3[ -]clause|three[ -]clause|new|modified|revised) bsd(?: licen[sc]e)?|bsd[ -](?:3|three)[ -]clause(?: licen[sc]e)?", r"bsd-3-clause", r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4", "bsd", r"(?:4[ -]clause|four[ -]clause|original) bsd(?: licen[sc]e)?|bsd[ -](?:4|four)[ -]clause(?: licen[sc]e)?", r"bsd-4-clause", r"spdx\.org/licenses/bsd-4-clause"),
    ("bsd", "bsd", r"bsd(?:-style)? licen[sc]e", r"0bsd", r"opensource\.org/licenses/bsd"),
    ("isc", "isc", r"isc licen[sc]e", r"isc", r"opensource\.org/licenses/isc"),
    ("mpl-2", "mozilla|mpl", r"(?:mozilla public licen[sc]e|(?<!\w)mpl),?[\s-]*(?:version|v\.?)?\s*2(?:\.0)?(?!\.?\d)", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("mpl-1", "mozilla|mpl", r"(?:mozilla public licen[sc]e|(?<!\w)mpl),?[\s-]*(?:version|v\.?)?\s*1(?:\.[01])?(?!\.?\d)", r"mpl-1\.[01]", r"mozilla\.org/mpl/mpl-1\.[01]"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", r"mpl", r"mozilla\.org/(?:en-us/)?mpl"),
    ("epl", "eclipse|epl", r"eclipse public licen[sc]e|(?<!\w)epl[\s-]*v?[12]\.0", r"epl-[12]\.0", r"eclipse\.org/(?:legal|org/documents)/epl"),
    ("edl", "eclipse", r"eclipse distribution licen[sc]e", r"edl-1\.0", r"eclipse\.org/org/documents/edl"),
    ("cddl", "common|cddl", r"common development and distribution licen[sc]e|cddl(?:[\s-]*v?1\.[01])?", r"cddl-1\.[01]", r"opensource\.org/licenses/cddl"),
    ("cpl", "common public", r"common public licen[sc]e", r"cpl-1\.0", r"opensource\.org/licenses/cpl"),
    ("artistic", "artistic", r"artistic licen[sc]e", r"artistic-[12]\.0", r"opensource\.org/licenses/artistic"),
    ("bsl-1", "boost", r"boost (?:software )?licen[sc]e(?:,?[\s-]*(?:version|v\.?)?\s*1\.0)?", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[sc]e", r"zlib", r"zlib\.net/zlib_license"),
    ("libpng", "libpng", r"libpng licen[sc]e", r"libpng(?:-2\.0)?", r"libpng\.org/pub/png/src/libpng-license"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "public|wtfpl", r"do what the fuck you want to public licen[sc]e|wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("eupl", "european|eupl", r"(?:european union public licen[sc]e|eupl)(?:,?[\s-]*(?:version|v\.?)?\s*1\.[012])?", r"eupl-1\.[012]", r"joinup\.ec\.europa\.eu/[a-z/]*eupl"),
    ("osl", "open software", r"open software licen[sc]e", r"osl-[123]\.[01]", r"opensource\.org/licenses/osl"),
    ("afl", "academic free", r"academic free licen[sc]e", r"afl-[123]\.[012]", r"opensource\.org/licenses/afl"),
    ("ms-pl", "microsoft public", r"microsoft public licen[sc]e", r"ms-pl", r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[sc]e", r"ms-rl", r"opensource\.org/licenses/ms-rl"),
    ("python", "python", r"python software foundation licen[sc]e", r"(?:psf|python)-2\.0", r"docs\.python\.org/[0-9a-z./]*license"),
    ("php", "php", r"php licen[sc]e", r"php-3\.0[12]?", r"php\.net/license"),
    ("ruby", "ruby", r"ruby licen[sc]e", r"ruby", r"ruby-lang\.org/[a-z/]*license"),
    ("openssl", "openssl", r"openssl licen[sc]e", r"openssl", r"openssl\.org/source/license"),
    ("ofl", "open|ofl", r"(?:sil )?(?:open font licen[sc]e|(?<!\w)ofl[\s-]*v?1\.[01])", r"ofl-1\.[01]", r"scripts\.sil\.org/ofl"),
    ("odbl", "open database", r"open database licen[sc]e", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", r"odc-by-1\.0", r"opendatacommons\.org/licenses/by"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e", r"pddl-1\.0", r"opendatacommons\.org/licenses/pddl"),
    ("cc0", "cc0", r"cc0(?: 1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by-nc-nd", "commercial|cc", r"creative commons attribution[- ]non-?commercial[- ]no-?derivatives?|(?<!\w)cc[ -]by[ -]nc[ -]nd(?:[ -][1-4]\.[05])?(?!\w)", r"cc-by-nc-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-nd"),
    ("cc-by-nc-sa", "commercial|cc", r"creative commons attribution[- ]non-?commercial[- ]share-?alike|(?<!\w)cc[ -]by[ -]nc[ -]sa(?:[ -][1-4]\.[05])?(?!\w)", r"cc-by-nc-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc", "commercial|cc", r"creative commons attribution[- ]non-?commercial|(?<!\w)cc[ -]by[ -]nc(?:[ -][1-4]\.[05])?(?!\w)", r"cc-by-nc-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "creative commons|cc", r"creative commons attribution[- ]no-?derivatives?|(?<!\w)cc[ -]by[ -]nd(?:[ -][1-4]\.[05])?(?!\w)", r"cc-by-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-sa", "creative commons|cc", r"creative commons attribution[- ]share-?alike|(?<!\w)cc[ -]by[ -]sa(?:[ -][1-4]\.[05])?(?!\w)", r"cc-by-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-sa"),
    ("cc-by", "creative commons|cc", r"creative commons attribution|(?<!\w)cc[ -]by[ -][1-4]\.[05]", r"cc-by-[1-4]\.[05]", r"creativecommons\.org/licenses/by/"),
    ("proprietary", "proprietary", r"proprietary (?:and confidential|licen[sc]e)", r"licenseref-proprietary", r"eula\.[a-z]+\.com"),
]

# Weight, extra keyword (the family's own one if empty), form.
FORMS = [
    (1.0, "spdx-license-identifier", r"spdx-license-identifier:\s*{spdx}(?![\w.+-])"),
    (0.95, "", r"(?:released|distributed|licen[sc]ed|available|published|provided)\s+under\s+(?:the\s+terms\s+of\s+)?(?:an?\s+|the\s+)?{name}"),
    (0.9, "", r"(?:subject|according)\s+to\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?{name}"),
    (0.9, "", r"licen[sc]e:\s*(?:the\s+)?{name}"),
    (0.85, "http", r"https?://(?:www\.)?{url}"),
    (0.85, "http", r"https?://(?:www\.)?(?:spdx\.org/licenses|opensource\.org/licen[sc]es?|choosealicense\.com/licenses)/{spdx}(?![\w+-])"),
    (0.8, "", r"(?:copy|text|terms)\s+of\s+(?:the\s+)?{name}"),
    (0.6, "", r"(?<!\w){name}(?!\w)"),
]


def spaced(name: str) -> str:
    """Any white space for a blank, in a class of signs, too."""
    return name.replace("[ -]", r"[\s-]+").replace("[- ]", r"[\s-]+").replace(" ", r"\s+")


def rules() -> list[tuple[str, float, str, str]]:
    """``(label, weight, keyword, regex)`` in priority order."""
    out = []
    for weight, keyword, form in FORMS:
        for label, own, name, spdx, url in FAMILIES:
            regex = form.replace("{name}", f"(?:{spaced(name)})").replace("{spdx}", spdx).replace("{url}", url)
            out.append((label, weight, keyword or "|".join(k.split()[0] for k in own.split("|")), regex))
    for label, weight, keyword, regex in GENERAL:
        out.append((label, weight, keyword, regex))
    return out


# Label, weight, keyword, regex of notices that name no family.
GENERAL = [
    ("mit", 0.95, "hereby", r"permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person"),
    ("isc", 0.95, "permission", r"permission\s+to\s+use,\s+copy,\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software"),
    ("bsd", 0.95, "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms"),
    ("public-domain", 0.8, "public", r"(?:released\s+in(?:to)?|dedicated\s+to)\s+the\s+public\s+domain"),
    ("gpl-3", 0.95, "either", r"either\s+version\s+3\s+of\s+the\s+licen[sc]e,?\s+or\s+\(at\s+your\s+option\)"),
    ("gpl-2", 0.95, "either", r"either\s+version\s+2\s+of\s+the\s+licen[sc]e,?\s+or\s+\(at\s+your\s+option\)"),
    ("lgpl", 0.9, "library", r"this\s+library\s+is\s+free\s+software[;:,]\s+you\s+can\s+redistribute\s+it"),
    ("gpl", 0.9, "program", r"this\s+program\s+is\s+free\s+software[;:,]\s+you\s+can\s+redistribute\s+it"),
    ("apache-2", 0.95, "compliance", r"you\s+may\s+not\s+use\s+this\s+(?:file|work|software)\s+except\s+in\s+compliance\s+with\s+the\s+licen[sc]e"),
    ("bsd-3", 0.95, "neither", r"neither\s+the\s+names?\s+of[\w\s,]{1,200}contributors\s+may\s+be\s+used\s+to\s+endorse"),
    ("zlib", 0.9, "altered", r"altered\s+source\s+versions\s+must\s+be\s+plainly\s+marked"),
    ("unlicense", 0.95, "unencumbered", r"free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain"),
    ("bsl-1", 0.95, "organization", r"free\s+of\s+charge,?\s+to\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy"),
    ("cc-by", 0.6, "creative", r"this\s+work\s+is\s+licen[sc]ed\s+under\s+an?\s+creative\s+commons\s+attribution"),
    ("no-warranty", 0.3, "warrant", r"without\s+warrant(?:y|ies)\s+of\s+any\s+kind"),
    ("copyright", 0.4, "copyright", r"copyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d"),
    ("proprietary", 0.5, "unauthori", r"unauthori[sz]ed\s+(?:copying|reproduction|distribution)\s+(?:of\s+this\s+\w+\s+)?is\s+(?:strictly\s+)?prohibited"),
]
