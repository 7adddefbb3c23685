"""License scans by ordered signature rules.

Each rule is a regex with a label, a keyword and a priority. Keywords are found first, all in one
pass over the text, and only rules whose keyword occurs are tried; whatever a rule finds contains its
keyword. A tag may be an expression of several identifiers; each is a detection of its own. Detections may overlap: one that
lies inside another of at least its priority is suppressed; of equal spans the higher priority wins,
then the earlier rule. What is left gives the labels, and the best of it the score.

Beside the rules stand four base phrases, found as consecutive words; their labels always stay.
Null texts are empty: no words, no labels, score 0. Rows stand for themselves; columns other than the
id and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame

from .text import WORD_BYTES, map_texts

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
SPANS = "spans array<struct<start:int, stop:int, label:string, priority:int>>"

#: Fixed values of the base.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Score of a detection by its rule's priority: bare names, names with a version, notices, addresses, tags.
SCORES = {1: 0.5, 2: 0.7, 3: 0.85, 4: 0.9, 5: 1.0}


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: Identifiers of licenses as they stand in machine-readable tags; one rule is made of each.
TAGS = """0bsd afl-3.0 agpl-3.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 bsd-1-clause bsd-2-clause bsd-3-clause
bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0
cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0
eupl-1.1 eupl-1.2 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl
mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sspl-1.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1""".split()

_V = r"(?:,?\s*\(?(?:version|ver\.?|v\.?)?\s*|[- ]v?)"  # between a name and its version
_OR = r"(?:\s+or\s+(?:\(at\s+your\s+option\)\s+)?(?:any\s+)?later(?:\s+version)?)?"

#: label | priority | keyword | pattern, on texts whose A-Z are in lower case.
SIGNATURES = rf"""
gpl-1.0 | 2 | general public | gnu\s+general\s+public\s+licen[cs]e{_V}1(?:\.0)?\b(?!\.\d)
gpl-2.0 | 2 | general public | gnu\s+general\s+public\s+licen[cs]e{_V}2(?:\.0)?\b(?!\.\d){_OR}
gpl-3.0 | 2 | general public | gnu\s+general\s+public\s+licen[cs]e{_V}3(?:\.0)?\b(?!\.\d){_OR}
gpl | 1 | general public | \bgnu\s+general\s+public\s+licen[cs]e\b
gpl | 1 | gnu | \bgnu\s+gpl\b
gpl-2.0 | 2 | gpl | \b(?:gnu\s+)?gpl[- ]?v?2(?:\.0)?(?:\+|-only|-or-later)?(?![\w.])
gpl-3.0 | 2 | gpl | \b(?:gnu\s+)?gpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.])
gpl | 3 | free software | this\s+program\s+is\s+free\s+software[;:,]?\s+you\s+can\s+redistribute\s+it
gpl | 3 | without even | without\s+even\s+the\s+implied\s+warranty\s+of\s+merchantability\s+or\s+fitness
gpl | 3 | received a copy | should\s+have\s+received\s+a\s+copy\s+of\s+the\s+gnu\s+general\s+public
gpl-2.0 | 4 | gnu.org | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | 4 | gnu.org | gnu\.org/licenses/gpl-3\.0
gpl | 4 | gnu.org | gnu\.org/(?:copyleft|licenses)/gpl\b(?!-)
lgpl-2.0 | 2 | library general | gnu\s+library\s+general\s+public\s+licen[cs]e(?:{_V}2(?:\.0)?\b)?
lgpl-2.1 | 2 | lesser general | gnu\s+lesser\s+general\s+public\s+licen[cs]e{_V}2\.1\b{_OR}
lgpl-3.0 | 2 | lesser general | gnu\s+lesser\s+general\s+public\s+licen[cs]e{_V}3(?:\.0)?\b{_OR}
lgpl | 1 | lesser general | \b(?:gnu\s+)?lesser\s+general\s+public\s+licen[cs]e\b
lgpl-2.1 | 2 | lgpl | \blgpl[- ]?v?2\.1(?:\+|-only|-or-later)?(?![\w.])
lgpl-3.0 | 2 | lgpl | \blgpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.])
lgpl | 1 | lgpl | \b(?:gnu\s+)?lgpl\b
lgpl | 4 | gnu.org | gnu\.org/(?:copyleft|licenses)/(?:old-licenses/)?lgpl
agpl-3.0 | 2 | affero | (?:gnu\s+)?affero\s+general\s+public\s+licen[cs]e(?:{_V}3(?:\.0)?\b)?{_OR}
agpl-3.0 | 2 | agpl | \bagpl[- ]?v?3(?:\.0)?(?:\+|-only|-or-later)?(?![\w.])
agpl | 1 | agpl | \b(?:gnu\s+)?agpl\b
agpl-3.0 | 4 | gnu.org | gnu\.org/licenses/agpl
gfdl | 1 | free documentation | gnu\s+free\s+documentation\s+licen[cs]e(?:{_V}1\.[1-3]\b)?
gfdl | 3 | invariant | with\s+no\s+invariant\s+sections,?\s+(?:with\s+)?no\s+front-cover\s+texts
gfdl | 4 | gnu.org | gnu\.org/(?:copyleft|licenses)/fdl
apache-1.0 | 2 | apache | \bapache\s+(?:software\s+)?licen[cs]e{_V}1\.0\b
apache-1.1 | 2 | apache | \bapache\s+(?:software\s+)?licen[cs]e{_V}1\.1\b
apache-2.0 | 2 | apache | \bapache\s+(?:software\s+)?licen[cs]e{_V}2(?:\.0)?\b
apache-2.0 | 2 | apache | \bapache[- ]v?2(?:\.0)?(?![\w.])
apache | 1 | apache | \bapache\s+(?:software\s+)?licen[cs]e\b
apache | 1 | apache | \bunder\s+(?:the\s+)?apache\s+terms\b
apache-2.0 | 3 | as is | distributed\s+on\s+an\s+.?as\s+is.?\s+basis,?\s+without\s+warranties\s+or\s+conditions
apache-2.0 | 3 | except in compliance | may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[cs]e
apache-2.0 | 4 | apache.org | apache\.org/licenses/license-2\.0
apache | 4 | apache.org | apache\.org/licenses/?(?!\w)
mit | 1 | mit | \bmit\s+licen[cs]e[d]?\b
mit | 1 | mit | \blicen[cs]ed\s+under\s+(?:the\s+)?mit\b
mit | 2 | expat | \bexpat\s+licen[cs]e\b
mit | 3 | permission is hereby | permission\s+is\s+hereby\s+granted,?\s+free\s+of\s+charge,?\s+to\s+any\s+person\s+obtaining\s+a\s+copy
mit | 3 | without restriction | to\s+deal\s+in\s+the\s+software\s+without\s+restriction
mit | 3 | substantial portions | copyright\s+notice\s+and\s+this\s+permission\s+notice\s+shall\s+be\s+included\s+in\s+all\s+copies\s+or\s+substantial\s+portions
mit | 4 | opensource.org | opensource\.org/licenses?/mit(?:-license)?\b
mit-0 | 2 | mit | \bmit\s+no\s+attribution\b
x11 | 2 | x11 | \bx11\s+licen[cs]e\b
x11 | 3 | contained in this notice | except\s+as\s+contained\s+in\s+this\s+notice,?\s+the\s+names?\s+of\s+the\s+(?:x\s+consortium|above\s+copyright)
bsd-2-clause | 2 | bsd | \b(?:bsd[- ]2[- ]clause|2[- ]clause\s+bsd|simplified\s+bsd|freebsd)(?:\s+licen[cs]e)?\b
bsd-3-clause | 2 | bsd | \b(?:bsd[- ]3[- ]clause|3[- ]clause\s+bsd|new\s+bsd|modified\s+bsd|revised\s+bsd)(?:\s+licen[cs]e)?\b
bsd-4-clause | 2 | bsd | \b(?:bsd[- ]4[- ]clause|4[- ]clause\s+bsd|original\s+bsd)(?:\s+licen[cs]e)?\b
0bsd | 2 | bsd | \b(?:0bsd|zero[- ]clause\s+bsd|bsd\s+zero\s+clause)\b
bsd | 1 | bsd | \bbsd(?:-style)?\s+licen[cs]e[d]?\b
bsd | 1 | bsd | \blicen[cs]ed\s+under\s+(?:the\s+)?bsd\b
bsd | 3 | redistribution and use | redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms
bsd-3-clause | 3 | endorse or promote | may\s+be\s+used\s+to\s+endorse\s+or\s+promote\s+products\s+derived
bsd-4-clause | 3 | advertising materials | all\s+advertising\s+materials\s+mentioning\s+features
bsd | 3 | binary form | redistributions\s+in\s+binary\s+form\s+must\s+reproduce
bsd | 4 | opensource.org | opensource\.org/licenses?/bsd
isc | 1 | isc | \bisc\s+licen[cs]e\b
isc | 3 | permission to use | permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software\s+for\s+any\s+purpose
isc | 4 | opensource.org | opensource\.org/licenses?/isc
mpl-1.0 | 2 | mozilla | mozilla\s+public\s+licen[cs]e{_V}1\.0\b
mpl-1.1 | 2 | mozilla | mozilla\s+public\s+licen[cs]e{_V}1\.1\b
mpl-2.0 | 2 | mozilla | mozilla\s+public\s+licen[cs]e{_V}2(?:\.0)?\b
mpl | 1 | mozilla | \bmozilla\s+public\s+licen[cs]e\b
mpl-2.0 | 2 | mpl | \bmpl[- ]?v?2(?:\.0)?(?![\w.])
mpl-1.1 | 2 | mpl | \bmpl[- ]?v?1\.1\b
mpl-2.0 | 3 | source code form | this\s+source\s+code\s+form\s+is\s+subject\s+to\s+the\s+terms\s+of\s+the\s+mozilla
mpl-2.0 | 4 | mozilla.org | mozilla\.org/(?:en-us/)?mpl/2\.0
mpl | 4 | mozilla.org | mozilla\.org/(?:en-us/)?mpl/?(?![\w/])
epl-1.0 | 2 | eclipse | eclipse\s+public\s+licen[cs]e{_V}1(?:\.0)?\b
epl-2.0 | 2 | eclipse | eclipse\s+public\s+licen[cs]e{_V}2(?:\.0)?\b
epl | 1 | eclipse | \beclipse\s+public\s+licen[cs]e\b
epl | 4 | eclipse.org | eclipse\.org/(?:legal/epl|org/documents/epl)
epl-1.0 | 1 | eclipse distribution | eclipse\s+distribution\s+licen[cs]e
cddl-1.0 | 2 | common development | common\s+development\s+and\s+distribution\s+licen[cs]e{_V}1\.0\b
cddl-1.1 | 2 | common development | common\s+development\s+and\s+distribution\s+licen[cs]e{_V}1\.1\b
cddl | 1 | common development | \bcommon\s+development\s+and\s+distribution\s+licen[cs]e\b
cddl | 1 | cddl | \bcddl\b
cpl-1.0 | 1 | common public | \bcommon\s+public\s+licen[cs]e(?:{_V}1\.0)?\b
ipl-1.0 | 1 | ibm public | \bibm\s+public\s+licen[cs]e(?:{_V}1\.0)?\b
eupl-1.1 | 2 | european union public | european\s+union\s+public\s+licen[cs]e{_V}1\.1\b
eupl-1.2 | 2 | european union public | european\s+union\s+public\s+licen[cs]e{_V}1\.2\b
eupl | 1 | european union public | \beuropean\s+union\s+public\s+licen[cs]e\b
eupl | 1 | eupl | \beupl\b
cecill-2.1 | 2 | cecill | \bcecill(?:\s+free\s+software\s+licen[cs]e)?[- ]?v?2\.1\b
cecill | 1 | cecill | \bcecill(?:-[bc])?\b
artistic-1.0 | 2 | artistic | \bartistic\s+licen[cs]e{_V}1\.0\b
artistic-2.0 | 2 | artistic | \bartistic\s+licen[cs]e{_V}2(?:\.0)?\b
artistic | 1 | artistic | \b(?:the\s+)?artistic\s+licen[cs]e\b
perl | 2 | perl | same\s+terms\s+as\s+perl(?:\s+itself)?
bsl-1.0 | 2 | boost | \bboost\s+software\s+licen[cs]e(?:{_V}1\.0)?\b
bsl-1.0 | 4 | boost.org | boost\.org/license_1_0
busl-1.1 | 2 | business source | \bbusiness\s+source\s+licen[cs]e(?:{_V}1\.1)?\b
sspl-1.0 | 2 | server side public | \bserver\s+side\s+public\s+licen[cs]e(?:{_V}1)?\b
elastic-2.0 | 2 | elastic | \belastic\s+licen[cs]e(?:{_V}2(?:\.0)?)?\b
commons-clause | 2 | commons clause | \bcommons\s+clause\b
polyform | 2 | polyform | \bpolyform\s+(?:noncommercial|small\s+business|shield|strict|perimeter)\s+licen[cs]e\b
unlicense | 1 | unlicense | \b(?:the\s+)?unlicense\b(?!-)
unlicense | 3 | public domain | this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain
unlicense | 4 | unlicense.org | \bunlicense\.org\b
public-domain | 1 | public domain | \b(?:in|into|to)\s+the\s+public\s+domain\b
public-domain | 2 | public domain | \bdedicated\s+to\s+the\s+public\s+domain\b
cc0-1.0 | 2 | cc0 | \bcc0(?:[- ]v?1(?:\.0)?)?(?:\s+universal)?\b
cc0-1.0 | 2 | creative commons | creative\s+commons\s+zero\b
cc0-1.0 | 4 | creativecommons.org | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm-1.0 | 4 | creativecommons.org | creativecommons\.org/publicdomain/mark/1\.0
cc-by | 1 | cc | \bcc[- ]by\b(?!-)
cc-by | 1 | creative commons | creative\s+commons\s+attribution(?:\s+licen[cs]e)?(?![- ]+(?:non|share|no))
cc-by-2.0 | 2 | cc | \bcc[- ]by[- ]v?2\.0\b
cc-by-2.5 | 2 | cc | \bcc[- ]by[- ]v?2\.5\b
cc-by-3.0 | 2 | cc | \bcc[- ]by[- ]v?3\.0\b
cc-by-4.0 | 2 | cc | \bcc[- ]by[- ]v?4\.0\b
cc-by-3.0 | 2 | creative commons | creative\s+commons\s+attribution\s+v?3\.0\b
cc-by-4.0 | 2 | creative commons | creative\s+commons\s+attribution\s+v?4\.0\b
cc-by-sa | 1 | cc | \bcc[- ]by[- ]sa\b(?![- ]v?\d)
cc-by-sa-3.0 | 2 | cc | \bcc[- ]by[- ]sa[- ]v?3\.0\b
cc-by-sa-4.0 | 2 | cc | \bcc[- ]by[- ]sa[- ]v?4\.0\b
cc-by-sa | 1 | creative commons | creative\s+commons\s+attribution[- ]+share[- ]?alike\b
cc-by-sa-4.0 | 2 | creative commons | creative\s+commons\s+attribution[- ]+share[- ]?alike\s+v?4\.0\b
cc-by-nc | 1 | cc | \bcc[- ]by[- ]nc\b(?![- ](?:v?\d|sa|nd))
cc-by-nc-4.0 | 2 | cc | \bcc[- ]by[- ]nc[- ]v?4\.0\b
cc-by-nc | 1 | creative commons | creative\s+commons\s+attribution[- ]+non[- ]?commercial\b(?![- ]+(?:share|no))
cc-by-nc-sa | 1 | cc | \bcc[- ]by[- ]nc[- ]sa\b(?:[- ]v?\d\.\d)?
cc-by-nc-sa | 1 | creative commons | creative\s+commons\s+attribution[- ]+non[- ]?commercial[- ]+share[- ]?alike\b
cc-by-nc-nd | 1 | cc | \bcc[- ]by[- ]nc[- ]nd\b(?:[- ]v?\d\.\d)?
cc-by-nc-nd | 1 | creative commons | creative\s+commons\s+attribution[- ]+non[- ]?commercial[- ]+no[- ]?deriv
cc-by-nd | 1 | cc | \bcc[- ]by[- ]nd\b(?:[- ]v?\d\.\d)?
cc-by-nd | 1 | creative commons | creative\s+commons\s+attribution[- ]+no[- ]?deriv
cc-by | 4 | creativecommons.org | creativecommons\.org/licenses/by/\d\.\d
cc-by-sa | 4 | creativecommons.org | creativecommons\.org/licenses/by-sa/\d\.\d
cc-by-nc | 4 | creativecommons.org | creativecommons\.org/licenses/by-nc/\d\.\d
cc-by-nd | 4 | creativecommons.org | creativecommons\.org/licenses/by-nd/\d\.\d
cc-by-nc-sa | 4 | creativecommons.org | creativecommons\.org/licenses/by-nc-sa/\d\.\d
cc-by-nc-nd | 4 | creativecommons.org | creativecommons\.org/licenses/by-nc-nd/\d\.\d
odbl-1.0 | 2 | database | \bopen\s+(?:data\s+commons\s+)?(?:open\s+)?database\s+licen[cs]e\b
odc-by-1.0 | 2 | open data commons | \bopen\s+data\s+commons\s+attribution\s+licen[cs]e\b
pddl-1.0 | 2 | public domain dedication | \bpublic\s+domain\s+dedication\s+and\s+licen[cs]e\b
odbl-1.0 | 4 | opendatacommons.org | opendatacommons\.org/licenses/odbl
odc-by-1.0 | 4 | opendatacommons.org | opendatacommons\.org/licenses/by
cdla-permissive | 2 | cdla | \bcdla[- ]permissive(?:[- ]\d\.0)?\b
cdla-sharing | 2 | cdla | \bcdla[- ]sharing(?:[- ]\d\.0)?\b
ogl-3.0 | 2 | open government | \bopen\s+government\s+licen[cs]e(?:\s*v?3(?:\.0)?)?\b
ofl-1.1 | 2 | open font | \b(?:sil\s+)?open\s+font\s+licen[cs]e(?:{_V}1\.1)?\b
ofl-1.1 | 4 | scripts.sil.org | scripts\.sil\.org/ofl
lppl-1.3c | 2 | latex project | \blatex\s+project\s+public\s+licen[cs]e\b
zlib | 1 | zlib | \bzlib(?:/libpng)?\s+licen[cs]e\b
zlib | 3 | as-is | provided\s+.?as-is.?,\s+without\s+any\s+express\s+or\s+implied\s+warranty
zlib | 3 | misrepresented | origin\s+of\s+this\s+software\s+must\s+not\s+be\s+misrepresented
libpng | 2 | libpng | \blibpng\s+licen[cs]e\b
openssl | 2 | openssl | \bopenssl\s+licen[cs]e\b
openssl | 3 | openssl | includes\s+software\s+developed\s+by\s+the\s+openssl\s+project
wtfpl | 2 | wtfpl | \bwtfpl\b
wtfpl | 3 | what the | do\s+what\s+the\s+f\S+\s+you\s+want\s+to\s+public\s+licen[cs]e
beerware | 2 | beer | \bbeer-?ware\s+licen[cs]e\b
json | 3 | good, not evil | shall\s+be\s+used\s+for\s+good,\s+not\s+evil
python-2.0 | 2 | python | \bpython\s+licen[cs]e{_V}2(?:\.0)?\b
psf-2.0 | 2 | python software | \bpython\s+software\s+foundation\s+licen[cs]e\b
php-3.01 | 2 | php | \bphp\s+licen[cs]e(?:{_V}3\.01)?\b
ruby | 2 | ruby | \bruby\s+licen[cs]e\b
ruby | 2 | ruby | same\s+terms\s+as\s+ruby\b
postgresql | 2 | postgresql | \bpostgresql\s+licen[cs]e\b
ncsa | 2 | illinois | university\s+of\s+illinois(?:/ncsa)?\s+open\s+source\s+licen[cs]e
afl-3.0 | 2 | academic free | \bacademic\s+free\s+licen[cs]e(?:{_V}3\.0)?\b
osl-3.0 | 2 | open software | \bopen\s+software\s+licen[cs]e(?:{_V}3\.0)?\b
ecl-2.0 | 2 | educational community | \beducational\s+community\s+licen[cs]e(?:{_V}2\.0)?\b
upl-1.0 | 2 | universal permissive | \buniversal\s+permissive\s+licen[cs]e(?:{_V}1\.0)?\b
ms-pl | 2 | microsoft | \bmicrosoft\s+public\s+licen[cs]e\b
ms-rl | 2 | microsoft | \bmicrosoft\s+reciprocal\s+licen[cs]e\b
apsl-2.0 | 2 | apple | \bapple\s+public\s+source\s+licen[cs]e(?:{_V}2(?:\.0)?)?\b
qpl-1.0 | 2 | q public | \bq\s+public\s+licen[cs]e\b
sleepycat | 2 | sleepycat | \bsleepycat\s+licen[cs]e\b
vim | 2 | vim | \bvim\s+licen[cs]e\b
w3c | 2 | w3c | \bw3c\s+software\s+(?:notice\s+and\s+)?licen[cs]e\b
zpl-2.1 | 2 | zope | \bzope\s+public\s+licen[cs]e(?:{_V}2\.1)?\b
mulanpsl-2.0 | 2 | mulan | \bmulan\s+permissive\s+software\s+licen[cs]e\b
bigscience-rail | 2 | rail | \b(?:bigscience\s+)?(?:open)?rail(?:-m)?\s+licen[cs]e\b
llama | 2 | llama | \bllama\s+\d(?:\.\d)?\s+community\s+licen[cs]e\b
proprietary | 1 | all rights | \ball\s+rights\s+reserved\b
proprietary | 2 | proprietary | \bproprietary\s+and\s+confidential\b
proprietary | 3 | unauthorized | unauthorized\s+copying\s+of\s+this\s+(?:file|document),?\s+via\s+any\s+medium
"""


#: Keyword of the tags, and what stands behind it: identifiers in any brackets, between operators.
TAG = "spdx-license-identifier"
_NAME = r"(?:\(\s*)*[\w.+:-]+(?:\s*\))*"
_EXPRESSION = re.compile(rf"{TAG}:\s*({_NAME}(?:\s+(?:or|and|with)\s+{_NAME})*)")


class Tagged:
    """Finds a pattern in the expressions of tags."""

    def __init__(self, pattern: str):
        self.pattern = re.compile(pattern)

    def finditer(self, text: str) -> Iterator[re.Match]:
        for m in _EXPRESSION.finditer(text):
            yield from self.pattern.finditer(text, *m.span(1))


def rules() -> list[Rule]:
    """All rules in their order: tags, then the signatures."""
    made = []
    for tag in TAGS:
        name = re.escape(tag).replace(r"\-", "-")
        made.append(Rule(tag, 5, TAG, rf"(?<![\w.+-]){name}(?:-only|-or-later|\+)?(?![\w.+-])"))
    for line in SIGNATURES.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ", 3)
        made.append(Rule(label, int(priority), keyword, pattern))
    return made


class Span(NamedTuple):
    start: int
    stop: int
    label: str
    priority: int


class Scanner:
    def __init__(self) -> None:
        self.rules = [(r, (Tagged if r.keyword == TAG else re.compile)(r.pattern)) for r in rules()]
        self.keywords = ahocorasick.Automaton()
        by: dict[str, list[int]] = {}
        for i, (rule, _) in enumerate(self.rules):
            by.setdefault(rule.keyword, []).append(i)
        for keyword, at in by.items():
            self.keywords.add_word(keyword, tuple(at))
        self.keywords.make_automaton()
        # A multi-word keyword may be broken over lines: blanks are one space for the prefilter.
        self.blanks = re.compile(r"\s+")

    def spans(self, text: str) -> list[Span]:
        """Detections that are left after suppression, in the order of the text."""
        tried = sorted({i for _, at in self.keywords.iter(self.blanks.sub(" ", text)) for i in at})
        found = [(m.start(), m.end(), self.rules[i][0].priority, i) for i in tried for m in self.rules[i][1].finditer(text)]
        return [Span(a, b, self.rules[i][0].label, p) for a, b, p, i in sorted(suppressed(found))]


def suppressed(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, stop, priority, rule) without those inside another of at least their priority."""
    kept: list[tuple[int, int, int, int]] = []
    # By start, longest first, so whatever contains a span stands before it; `open` holds the spans
    # before it that reach furthest, by priority.
    reach: dict[int, int] = {}
    equal: dict[tuple[int, int], tuple[int, int]] = {}
    for start, stop, priority, rule in found:
        best = equal.get((start, stop))
        if best is None or (-priority, rule) < best:
            equal[start, stop] = (-priority, rule)
    for (start, stop), (low, rule) in sorted(equal.items(), key=lambda x: (x[0][0], -x[0][1])):
        if any(p >= -low and far >= stop for p, far in reach.items()):
            continue
        kept.append((start, stop, -low, rule))
        reach[-low] = max(reach.get(-low, -1), stop)
    return kept


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """The first word of each place of a base phrase, with its label."""
    line = b" " + b" ".join(words) + b" "
    found = []
    for phrase, label in BASE.items():
        sought = b" " + phrase.encode() + b" "
        at = line.find(sought)
        word = last = 0
        while at >= 0:
            word += line.count(b" ", last, at)
            found.append((word, label))
            last = at
            at = line.find(sought, at + 1)
    return found


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """One row per document: base places, labels, score, and the detections if `spans`."""
    made: list[Scanner] = []
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

    def step(ids, texts):
        if not made:
            made.append(Scanner())
        out = {c.split()[0]: [] for c in SCHEMA.split(", ")[1:]} | ({"spans": []} if spans else {})
        for raw in texts:
            words = raw.translate(WORD_BYTES).split()
            places = base_places(words)
            found = made[0].spans(raw.translate(lower).decode("utf-8", "replace"))
            base = {label for _, label in places}
            score = max([SCORES[s.priority] for s in found] + [SCORES[1]] * bool(places), default=0.0)
            at = [word for word, _ in places]
            row = (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s.label for s in found})), score)
            for column, value in zip(out, (*row, [s._asdict() for s in found])):
                out[column].append(value)
        return {"doc_id": ids, **out}

    return map_texts(docs, step, SCHEMA + f", {SPANS}" * spans, doc_id, text)
