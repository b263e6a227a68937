"""License scans: ordered signature rules over whole texts, in DataFrame functions only.

Each rule has a keyword, a pattern, a label, a priority and a confidence; a
rule with a license's name also has keywords for the ways to write that name.
A text is lower-cased once; a rule's pattern runs only where the text holds its
keyword and one of its name's, as every match of it does. A detection goes
where another one of at least its priority covers its interval, so the specific
rule stands over the general one and nothing is reported twice.

Everything happens inside a row: no shuffle, no state between documents.

Defined results
* null or empty text: no detections, score 0.
* equal intervals of equal priority: the rule earlier in the list stays.
* repeated rows are scanned each for itself; extra columns pass through, and an
  existing column of the output's name is replaced.
* only A-Z is folded; characters U+0001 and U+0002, which mark matches
  internally, count as spaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float
    #: Every match holds one of these, if there are any.
    names: tuple[str, ...] = ()


# Labels, names as licenses write them (regular expressions), and keywords of which each such name holds one.
_LICENSES = (
    ("mit", ("mit", "expat"), r"mit|expat"),
    ("mit-0", ("mit no attribution", "mit-0"), r"mit no attribution|mit-0"),
    ("apache-1.1", ("apache",), r"apache(?: software)?(?: license)?,? ?(?:version |v\.? ?)?1\.1"),
    ("apache-2", ("apache",), r"apache(?: software)?(?: license)?,? ?(?:version |v\.? ?|-)?2(?:\.0)?"),
    ("bsd-2-clause", ("bsd",), r"bsd[ -]2[ -]clause|simplified bsd|freebsd"),
    ("bsd-3-clause", ("bsd",), r"bsd[ -]3[ -]clause|new bsd|modified bsd|revised bsd"),
    ("bsd-4-clause", ("bsd",), r"bsd[ -]4[ -]clause|original bsd"),
    ("0bsd", ("bsd",), r"0bsd|zero[ -]clause bsd"),
    ("gpl-2", ("gpl", "general public license"), r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v\.? ?|-)?2(?:\.0)?(?:-only)?"),
    ("gpl-3", ("gpl", "general public license"), r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v\.? ?|-)?3(?:\.0)?(?:-only)?"),
    ("gpl-2-or-later", ("gpl", "general public license"), r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v\.? ?|-)?2(?:\.0)?(?:\+|-or-later|,? or (?:any later|\(at your option\)))"),
    ("gpl-3-or-later", ("gpl", "general public license"), r"(?:gnu )?(?:gpl|general public license),? ?(?:version |v\.? ?|-)?3(?:\.0)?(?:\+|-or-later|,? or (?:any later|\(at your option\)))"),
    ("lgpl-2.1", ("lgpl", "lesser general public license"), r"(?:gnu )?(?:lgpl|lesser general public license),? ?(?:version |v\.? ?|-)?2\.1"),
    ("lgpl-3", ("lgpl", "lesser general public license"), r"(?:gnu )?(?:lgpl|lesser general public license),? ?(?:version |v\.? ?|-)?3(?:\.0)?"),
    ("agpl-3", ("agpl", "affero general public license"), r"(?:gnu )?(?:agpl|affero general public license),? ?(?:version |v\.? ?|-)?3(?:\.0)?"),
    ("mpl-1.1", ("mpl", "mozilla public license"), r"(?:mpl|mozilla public license),? ?(?:version |v\.? ?|-)?1\.1"),
    ("mpl-2", ("mpl", "mozilla public license"), r"(?:mpl|mozilla public license),? ?(?:version |v\.? ?|-)?2(?:\.0)?"),
    ("epl-1", ("epl", "eclipse public license"), r"(?:epl|eclipse public license),? ?(?:version |v\.? ?|-)?1(?:\.0)?"),
    ("epl-2", ("epl", "eclipse public license"), r"(?:epl|eclipse public license),? ?(?:version |v\.? ?|-)?2(?:\.0)?"),
    ("cddl-1", ("cddl", "common development and distribution license"), r"(?:cddl|common development and distribution license),? ?(?:version |v\.? ?|-)?1(?:\.[01])?"),
    ("eupl-1.2", ("eupl", "european union public licen"), r"(?:eupl|european union public licen[sc]e),? ?(?:version |v\.? ?|-)?1\.2"),
    ("isc", ("isc",), r"isc"),
    ("zlib", ("zlib",), r"zlib(?:/libpng)?"),
    ("boost-1", ("boost software", "bsl-1.0"), r"boost software(?: license)?,? ?(?:version |v\.? ?|-)?1(?:\.0)?|bsl-1\.0"),
    ("unlicense", ("unlicense",), r"(?:the )?unlicense"),
    ("wtfpl", ("wtfpl", "do what the fuck you want to public license"), r"wtfpl|do what the fuck you want to public license"),
    ("artistic-2", ("artistic",), r"artistic(?: license)?,? ?(?:version |v\.? ?|-)?2(?:\.0)?"),
    ("python-2", ("psf", "python software foundation"), r"(?:psf|python software foundation)(?: license)?,? ?(?:version |v\.? ?|-)?2?"),
    ("postgresql", ("postgresql",), r"postgresql"),
    ("openssl", ("openssl",), r"openssl"),
    ("ofl-1.1", ("ofl", "sil open font license"), r"(?:ofl|sil open font license),? ?(?:version |v\.? ?|-)?1\.1"),
    ("cc0-1.0", ("cc0", "creative commons zero"), r"cc0(?:[ -]1\.0)?|creative commons zero"),
    ("cc-by", ("cc-", "cc ", "creative commons"), r"(?:cc|creative commons)[ -](?:by|attribution)"),
    ("cc-by-sa", ("cc-", "cc ", "creative commons"), r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:sa|share[ -]?alike)"),
    ("cc-by-nc", ("cc-", "cc ", "creative commons"), r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non[ -]?commercial)"),
    ("cc-by-nd", ("cc-", "cc ", "creative commons"), r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nd|no[ -]?deriv(?:s|ative)s?)"),
    ("cc-by-nc-sa", ("cc-", "cc ", "creative commons"), r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non[ -]?commercial)[ -](?:sa|share[ -]?alike)"),
    ("cc-by-nc-nd", ("cc-", "cc ", "creative commons"), r"(?:cc|creative commons)[ -](?:by|attribution)[ -](?:nc|non[ -]?commercial)[ -](?:nd|no[ -]?deriv(?:s|ative)s?)"),
    ("proprietary", ("proprietary",), r"proprietary(?: and confidential)?"),
    ("commercial", ("commercial",), r"commercial"),
)

#: How texts name a license: keyword, pattern around the name, priority, confidence.
_FORMS = (
    ("spdx-license-identifier", r"spdx-license-identifier:\s*(?:{name})\b", 5, 1.0),
    ("licens", r"\b(?:re)?licensed\s+(?:to you\s+)?under\s+(?:the\s+)?(?:terms of\s+)?(?:the\s+)?(?:{name})\b", 4, 0.95),
    ("released", r"\breleased\s+under\s+(?:the\s+)?(?:{name})\b", 4, 0.95),
    ("distributed", r"\bdistributed\s+under\s+(?:the\s+)?(?:{name})\b", 4, 0.95),
    ("available", r"\bavailable\s+under\s+(?:the\s+)?(?:{name})\b", 4, 0.9),
    ("licen", r"\bunder\s+the\s+(?:terms\s+of\s+the\s+)?(?:{name})\s+licen[sc]e\b", 4, 0.9),
    ("licen", r"\blicen[sc]e\s*[:=]\s*[\"']?(?:{name})\b", 3, 0.85),
    ("licen", r"\b(?:{name})[ -]licen[sc]ed?\b", 2, 0.8),
    ("licen", r"\blicen[sc]e\s*\(\s*(?:{name})\s*\)", 2, 0.8),
)

#: Sentences of the licenses themselves and of the notices that go with them: label, keyword, pattern, priority, confidence.
_WORDINGS = (
    ("mit", "permission", r"\bpermission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy\s+of\s+this\s+software\s+and\s+associated", 4, 0.98),
    ("mit", "permission", r"\bthe\s+above\s+copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included", 3, 0.9),
    ("mit", "software", r"\bto\s+deal\s+in\s+the\s+software\s+without\s+restriction", 3, 0.9),
    ("mit", "software", r"\bsublicense,?\s+and/or\s+sell\s+copies\s+of\s+the\s+software", 3, 0.9),
    ("mit", "licen", r"\bopensource\.org/licenses/mit\b", 4, 0.95),
    ("mit-0", "permission", r"\bpermission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?[^.]{0,200}\bwithout\s+restriction,?\s+including\s+without\s+limitation[^.]{0,200}sell\s+copies\s+of\s+the\s+software\s*\.", 3, 0.7),
    ("apache-2", "licen", r"\blicensed\s+under\s+the\s+apache\s+license,?\s+version\s+2\.0\s+\(the\s+[\"“]?license", 5, 0.99),
    ("apache-2", "licen", r"\bapache\.org/licenses/license-2\.0", 4, 0.95),
    ("apache-2", "licen", r"\byou\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+license\b", 3, 0.9),
    ("apache-2", "licen", r"\bsee\s+the\s+license\s+for\s+the\s+specific\s+language\s+governing\s+permissions\s+and\s+limitations", 3, 0.9),
    ("apache-2", "licen", r"\bperpetual,?\s+worldwide,?\s+non-exclusive,?\s+no-charge,?\s+royalty-free,?\s+irrevocable\s+(?:copyright|\(except\b[^)]{0,60}\)\s+patent)\s+license", 3, 0.95),
    ("apache-1.1", "software", r"\bthis\s+product\s+includes\s+software\s+developed\s+by\s+the\s+apache\s+software\s+foundation", 3, 0.85),
    ("apache-1.1", "permission", r"\bproducts\s+derived\s+from\s+this\s+software\s+may\s+not\s+be\s+called\s+[\"“]?apache", 3, 0.85),
    ("bsd", "redistribut", r"\bredistributions\s+of\s+source\s+code\s+must\s+retain\s+the\s+above\s+copyright\s+notice", 2, 0.8),
    ("bsd", "redistribut", r"\bredistributions\s+in\s+binary\s+form\s+must\s+reproduce\s+the\s+above\s+copyright\s+notice", 2, 0.8),
    ("bsd", "software", r"\bthis\s+software\s+is\s+provided\s+by\s+the\s+(?:copyright\s+holders?|regents|authors?)\b[^.]{0,60}[\"“]?as\s+is\b", 2, 0.75),
    ("bsd-3-clause", "software", r"\bneither\s+the\s+names?\s+of\b[^.]{0,160}\bmay\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products\s+derived\s+from\s+this\s+software", 4, 0.95),
    ("bsd-4-clause", "software", r"\ball\s+advertising\s+materials\s+mentioning\s+features\s+or\s+use\s+of\s+this\s+software\s+must\s+display", 4, 0.95),
    ("bsd-4-clause", "software", r"\bthis\s+product\s+includes\s+software\s+developed\s+by\s+the\s+university\s+of\s+california", 3, 0.85),
    ("bsd-2-clause", "licen", r"\bopensource\.org/licenses/bsd-2-clause\b", 4, 0.95),
    ("bsd-3-clause", "licen", r"\bopensource\.org/licenses/bsd-3-clause\b", 4, 0.95),
    ("0bsd", "permission", r"\bpermission\s+to\s+use,\s+copy,\s+modify,?\s+and/or\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted\s*\.", 4, 0.9),
    ("isc", "permission", r"\bpermission\s+to\s+use,\s+copy,\s+modify,?\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose\s+with\s+or\s+without\s+fee\s+is\s+hereby\s+granted,\s+provided", 4, 0.95),
    ("gpl-2-or-later", "licen", r"\beither\s+version\s+2\s+of\s+the\s+license,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 4, 0.97),
    ("gpl-3-or-later", "licen", r"\beither\s+version\s+3\s+of\s+the\s+license,?\s+or\s+\(at\s+your\s+option\)\s+any\s+later\s+version", 4, 0.97),
    ("gpl", "software", r"\bthis\s+program\s+is\s+free\s+software[;:]?\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify", 2, 0.85),
    ("gpl", "licen", r"\bgnu\s+general\s+public\s+license\s+as\s+published\s+by\s+the\s+free\s+software\s+foundation", 2, 0.9),
    ("gpl", "licen", r"\byou\s+should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public\s+license", 2, 0.9),
    ("gpl-2", "licen", r"\bgnu\s+general\s+public\s+license\s+version\s+2,\s+june\s+1991", 5, 0.99),
    ("gpl-3", "licen", r"\bgnu\s+general\s+public\s+license\s+version\s+3,\s+29\s+june\s+2007", 5, 0.99),
    ("gpl", "licen", r"\bgnu\.org/licenses/gpl(?:-[23]\.0)?\b", 2, 0.85),
    ("gpl-3", "licen", r"\beveryone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+copies\s+of\s+this\s+license\s+document,\s+but\s+changing\s+it\s+is\s+not\s+allowed", 1, 0.5),
    ("lgpl", "software", r"\bthis\s+library\s+is\s+free\s+software[;:]?\s+you\s+can\s+redistribute\s+it\s+and/or\s+modify", 3, 0.9),
    ("lgpl", "licen", r"\bgnu\s+(?:lesser|library)\s+general\s+public\s+license\b", 2, 0.85),
    ("lgpl-2.1", "licen", r"\bgnu\s+lesser\s+general\s+public\s+license\s+version\s+2\.1,\s+february\s+1999", 5, 0.99),
    ("agpl-3", "licen", r"\bgnu\s+affero\s+general\s+public\s+license\s+version\s+3,\s+19\s+november\s+2007", 5, 0.99),
    ("agpl", "licen", r"\bgnu\s+affero\s+general\s+public\s+license\b", 2, 0.85),
    ("agpl", "remotely", r"\ball\s+users\s+interacting\s+with\s+it\s+remotely\s+through\s+a\s+computer\s+network", 3, 0.8),
    ("mpl-2", "licen", r"\bthis\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla\s+public\s+license,?\s+v\.\s*2\.0", 5, 0.99),
    ("mpl-2", "licen", r"\bmozilla\.org/mpl/2\.0", 4, 0.95),
    ("mpl-2", "distribut", r"\bif\s+a\s+copy\s+of\s+the\s+mpl\s+was\s+not\s+distributed\s+with\s+this\s+file", 4, 0.95),
    ("mpl-1.1", "licen", r"\bthe\s+contents\s+of\s+this\s+file\s+are\s+subject\s+to\s+the\s+mozilla\s+public\s+license\s+version\s+1\.1", 5, 0.99),
    ("epl-2", "licen", r"\bmade\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+license\s+(?:v\.?\s*)?2\.0", 5, 0.98),
    ("epl-1", "licen", r"\bmade\s+available\s+under\s+the\s+terms\s+of\s+the\s+eclipse\s+public\s+license\s+v1\.0", 5, 0.98),
    ("epl", "licen", r"\beclipse\.org/legal/epl", 3, 0.85),
    ("cddl-1", "licen", r"\bsubject\s+to\s+the\s+terms\s+of\s+the\s+common\s+development\s+and\s+distribution\s+license", 4, 0.95),
    ("eupl-1.2", "licen", r"\blicensed\s+under\s+the\s+eupl,?\s+version\s+1\.2", 5, 0.98),
    ("zlib", "software", r"\bthis\s+software\s+is\s+provided\s+['‘]as-is['’],\s+without\s+any\s+express\s+or\s+implied\s+warranty", 4, 0.95),
    ("zlib", "software", r"\bthe\s+origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented", 3, 0.9),
    ("zlib", "software", r"\baltered\s+source\s+versions\s+must\s+be\s+plainly\s+marked\s+as\s+such,?\s+and\s+must\s+not\s+be\s+misrepresented\s+as\s+being\s+the\s+original\s+software", 3, 0.9),
    ("boost-1", "software", r"\bto\s+any\s+person\s+or\s+organization\s+obtaining\s+a\s+copy\s+of\s+the\s+software\s+and\s+accompanying\s+documentation\s+covered\s+by\s+this\s+license", 5, 0.98),
    ("boost-1", "licen", r"\bboost\.org/license_1_0", 4, 0.95),
    ("unlicense", "software", r"\bthis\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", 5, 0.99),
    ("unlicense", "software", r"\banyone\s+is\s+free\s+to\s+copy,\s+modify,\s+publish,\s+use,\s+compile,\s+sell,\s+or\s+distribute\s+this\s+software", 4, 0.95),
    ("wtfpl", "licen", r"\beveryone\s+is\s+permitted\s+to\s+copy\s+and\s+distribute\s+verbatim\s+or\s+modified\s+copies\s+of\s+this\s+license\s+document", 4, 0.9),
    ("artistic-2", "licen", r"\bthis\s+license\s+establishes\s+the\s+terms\s+under\s+which\s+a\s+given\s+free\s+software\s+package\s+may\s+be\s+copied", 4, 0.9),
    ("python-2", "software", r"\bpython\s+software\s+foundation\s+license\s+version\s+2\b", 5, 0.98),
    ("python-2", "licen", r"\bpsf\s+is\s+making\s+python\s+available\s+to\s+licensee", 4, 0.95),
    ("postgresql", "permission", r"\bpermission\s+to\s+use,\s+copy,\s+modify,\s+and\s+distribute\s+this\s+software\s+and\s+its\s+documentation\s+for\s+any\s+purpose,\s+without\s+fee,\s+and\s+without\s+a\s+written\s+agreement", 5, 0.97),
    ("openssl", "software", r"\bthis\s+product\s+includes\s+software\s+developed\s+by\s+the\s+openssl\s+project", 4, 0.95),
    ("ofl-1.1", "software", r"\bthis\s+font\s+software\s+is\s+licensed\s+under\s+the\s+sil\s+open\s+font\s+license,?\s+version\s+1\.1", 5, 0.99),
    ("ofl-1.1", "software", r"\bthe\s+font\s+software\s+may\s+not\s+be\s+sold\s+by\s+itself", 3, 0.85),
    ("cc0-1.0", "dedicated", r"\bthe\s+person\s+who\s+associated\s+a\s+work\s+with\s+this\s+deed\s+has\s+dedicated\s+the\s+work\s+to\s+the\s+public\s+domain", 5, 0.98),
    ("cc0-1.0", "copyright", r"\bto\s+the\s+extent\s+possible\s+under\s+law,[^.]{0,120}\bwaived\s+all\s+copyright", 4, 0.95),
    ("cc0-1.0", "creativecommons", r"\bcreativecommons\.org/publicdomain/zero/1\.0", 5, 0.98),
    ("public-domain", "creativecommons", r"\bcreativecommons\.org/publicdomain/mark/1\.0", 4, 0.9),
    ("cc-by", "creativecommons", r"\bcreativecommons\.org/licenses/by/[1-4]\.[05]", 4, 0.95),
    ("cc-by-sa", "creativecommons", r"\bcreativecommons\.org/licenses/by-sa/[1-4]\.[05]", 4, 0.95),
    ("cc-by-nc", "creativecommons", r"\bcreativecommons\.org/licenses/by-nc/[1-4]\.[05]", 4, 0.95),
    ("cc-by-nd", "creativecommons", r"\bcreativecommons\.org/licenses/by-nd/[1-4]\.[05]", 4, 0.95),
    ("cc-by-nc-sa", "creativecommons", r"\bcreativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]", 4, 0.95),
    ("cc-by-nc-nd", "creativecommons", r"\bcreativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]", 4, 0.95),
    ("cc-by-sa", "licen", r"\bif\s+you\s+remix,\s+transform,\s+or\s+build\s+upon\s+the\s+material,\s+you\s+must\s+distribute\s+your\s+contributions\s+under\s+the\s+same\s+license", 3, 0.85),
    ("cc-by-nd", "distribut", r"\bif\s+you\s+remix,\s+transform,\s+or\s+build\s+upon\s+the\s+material,\s+you\s+may\s+not\s+distribute\s+the\s+modified\s+material", 3, 0.85),
    ("proprietary", "proprietary", r"\bproprietary\s+and\s+confidential\b", 3, 0.8),
    ("proprietary", "prohibited", r"\bunauthorized\s+(?:copying|use|reproduction|distribution)\b[^.]{0,80}\bstrictly\s+prohibited", 3, 0.85),
    ("proprietary", "permission", r"\bno\s+part\s+of\s+this\s+(?:publication|document|work|book)\s+may\s+be\s+reproduced\b[^.]{0,200}\bpermission", 3, 0.85),
    ("proprietary", "licen", r"\bend[- ]user\s+license\s+agreement\b", 2, 0.75),
    ("proprietary", "licen", r"\bthis\s+software\s+is\s+licensed,\s+not\s+sold\b", 3, 0.85),
    ("warranty-disclaimer", "warrant", r"\bwithout\s+warranty\s+of\s+any\s+kind,\s+express\s+or\s+implied", 0, 0.4),
    ("warranty-disclaimer", "warrant", r"\bwithout\s+even\s+the\s+implied\s+warranty\s+of\s+merchantability", 0, 0.4),
    ("warranty-disclaimer", "warrant", r"\bdistributed\s+on\s+an\s+[\"“]?as\s+is[\"”]?\s+basis,?\s+without\s+warranties", 0, 0.4),
)

#: Texts that name no license but speak as one.
_PHRASES = (
    Rule("mit", "permission is hereby granted", r"permission is hereby granted,? free of charge", 3, 0.9),
    Rule("bsd-3-clause", "redistribution and use", r"redistribution and use in source and binary forms", 3, 0.8),
    Rule("isc", "permission to use, copy, modify", r"permission to use, copy, modify,? and(?:/or)? distribute this software", 3, 0.8),
    Rule("gpl", "gnu general public license", r"gnu general public license", 1, 0.7),
    Rule("cc-by-nc", "cc", r"\bcc\s+by\s+nc\b", 3, 0.9),
    Rule("public-domain", "public domain", r"\b(?:in|into|to) the public domain\b", 2, 0.7),
    Rule("all-rights-reserved", "all rights reserved", r"\ball rights reserved\b", 1, 0.6),
    Rule("copyright", "copyright", r"\bcopyright\s+(?:\(c\)|©)?\s*(?:19|20)\d\d\b", 1, 0.5),
    Rule("other", "licen", r"\bunder\s+(?:the|this|a)\s+licen[sc]e\b", 0, 0.3),
)

RULES: tuple[Rule, ...] = (
    *(
        Rule(label, keyword, pattern.replace("{name}", name), priority, confidence, names)
        for label, names, name in _LICENSES
        for keyword, pattern, priority, confidence in _FORMS
    ),
    *_PHRASES,
    *(Rule(*r) for r in _WORDINGS),
)
#: Licenses whose names all hold the same keyword.
_NAME_KEYWORD = {label: names[0] for label, names, _ in _LICENSES if len(names) == 1}

_OPEN, _SHUT = "\u0001", "\u0002"
_SPAN = "struct<start:int,stop:int,rule:int,priority:int,label:string,confidence:double>"


def fold(text: Column) -> Column:
    """A-Z to a-z and nothing else, match marks to spaces.

    ``lower`` is the fast path: where it could touch anything but A-Z, the
    character-wise ``translate`` stands in.
    """
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\u0001\u0002", "abcdefghijklmnopqrstuvwxyz  "
    plain = F.octet_length(text) == F.char_length(text)
    marks = text.contains(_OPEN) | text.contains(_SHUT)
    return F.when(plain & ~marks, F.lower(text)).otherwise(F.translate(text, upper, low))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: a column named twice, or in a lambda, is computed each time."""
    return F.transform(F.array(value), body)[0]


def _blocks(items: Column) -> Column:
    """An array as an array of arrays, about as many as each is long: a fold that appends then copies little."""
    size = lambda a: F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(a))).cast("int"))
    starts = lambda a: F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), size(a))
    return _let(items, lambda a: F.transform(starts(a), lambda i: F.slice(a, i, size(a))))


def _offsets(sizes: Column) -> Column:
    """For each of an array's numbers the sum of those before it."""
    running = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    fold = lambda a: F.aggregate(a, running, add, lambda x: x["out"])
    total = lambda b: F.aggregate(b, F.lit(0), lambda s, n: s + n)

    def both(blocks: Column) -> Column:
        before = fold(F.transform(blocks, total))
        return F.flatten(F.zip_with(blocks, before, lambda b, first: F.transform(fold(b), lambda x: x + first)))

    return _let(_blocks(sizes), both)


def _spans(text: Column, rule: Column) -> Column:
    """All matches of one rule, as spans: marks are put round each match, and lengths before them are summed."""

    def span(piece: Column, start: Column) -> Column:
        return F.struct(
            start.alias("start"),
            (start + F.instr(piece, _SHUT) - 1).alias("stop"),
            rule["id"].alias("rule"),
            rule["priority"].alias("priority"),
            rule["label"].alias("label"),
            rule["confidence"].alias("confidence"),
        )

    def found(pieces: Column) -> Column:
        # A piece but the first is a match, its mark, and what follows; marks are no part of the text.
        at = _offsets(F.transform(pieces, lambda p, i: F.length(p) - F.when(i > 0, 1).otherwise(0)))
        from_second = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
        return F.when(F.size(pieces) > 1, F.zip_with(from_second(pieces), from_second(at), span)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return _let(F.split(F.regexp_replace(text, rule["pattern"], f"{_OPEN}$0{_SHUT}"), _OPEN), found)


def _uncovered(spans: Column) -> Column:
    """Spans that no other span of at least their priority covers.

    Sorted by start, longest first, best priority first, earliest rule first:
    a span's cover then stands before it, so one pass with the furthest end
    per priority finds it.
    """
    top = max(r.priority for r in RULES)
    key = F.struct
    ordered = F.sort_array(
        F.transform(
            spans,
            lambda s: key(
                s["start"].alias("start"), (-s["stop"]).alias("end"), (-s["priority"]).alias("rank"), s["rule"].alias("rule"), s.alias("span")
            ),
        )
    )
    none = F.array().cast(f"array<{_SPAN}>")

    def step(acc: Column, o: Column) -> Column:
        s = o["span"]
        covered = F.element_at(acc["ends"], s["priority"] + 1) >= s["stop"]
        # ends[p]: the furthest end of spans with priority p or more
        ends = F.transform(
            acc["ends"], lambda e, i: F.when(i <= s["priority"], F.greatest(e, s["stop"])).otherwise(e)
        )
        return F.struct(
            ends.alias("ends"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(s))).alias("out")
        )

    def block(acc: Column, some: Column) -> Column:
        done = F.aggregate(some, F.struct(acc["ends"].alias("ends"), none.alias("out")), step)
        return F.struct(done["ends"].alias("ends"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    start = F.struct(F.array_repeat(F.lit(-1), top + 1).alias("ends"), F.array().cast(f"array<array<{_SPAN}>>").alias("out"))
    # A wider span that starts at the same place sorts first even if its priority is lower; that is no cover, as ends[] keeps priorities apart.
    return F.flatten(F.aggregate(_blocks(ordered), start, block, lambda a: a["out"]))


def scan(df: DataFrame, text: str = "text", out: str = "licenses", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``out``: array of kept detections (start, stop, rule, priority, label, confidence), by start."""
    groups: dict[tuple[str, ...], list[Column]] = {}
    for i, r in enumerate(rules):
        groups.setdefault(r.names, []).append(
            F.struct(
                F.lit(i).alias("id"),
                F.lit(r.label).alias("label"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.pattern).alias("pattern"),
                F.lit(r.priority).alias("priority"),
                F.lit(r.confidence).alias("confidence"),
            )
        )
    # Without names any text will do: every text holds "".
    table = F.array(
        *[
            F.struct(F.array(*map(F.lit, names or ("",))).alias("names"), F.array(*own).alias("rules"))
            for names, own in groups.items()
        ]
    )
    keywords = sorted({r.keyword for r in rules}, key=len)
    anchors = [k for k in keywords if not any(o != k and o in k for o in keywords)]
    none = F.array().cast(f"array<{_SPAN}>")
    own = "body"
    while own in df.columns or own == out:
        own = f"_{own}"
    body = F.col(own)
    gate = F.lit(False)
    for k in anchors:
        gate = gate | body.contains(k)
    named = F.filter(table, lambda g: F.exists(g["names"], lambda n: F.contains(body, n)))
    live = F.flatten(F.transform(named, lambda g: F.filter(g["rules"], lambda r: F.contains(body, r["keyword"]))))
    found = _uncovered(F.flatten(F.transform(live, lambda r: _spans(body, r))))
    return (
        df.withColumn(own, fold(F.coalesce(F.col(text), F.lit(""))))
        .withColumn(out, F.when(gate, found).otherwise(none))
        .drop(own)
    )
