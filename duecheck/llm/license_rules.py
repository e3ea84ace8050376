r"""Signature rules of licenses and notices, in order of rank.

A line reads: label | priority | keywords | expression. Expressions are matched on lower-cased text; every match holds
all keywords, and one of ANCHORS or CC_BY. ``~`` stands for white space, ``<`` and ``>`` for the ends of a word. Priority 1 is a
tag or an address, 2 a name with its version, 3 a name, 4 a notice, 5 a guess. Dialect: what Java and Python read alike.
"""

import re
from dataclasses import dataclass

ANCHORS = ["licen", "copyright", "reserved", "domain", "commons", "cc-by", "cc0", "gnu", "gpl", "spdx", "warranty",
           "(c)", "©", "wtfpl", "hereby", "mozilla.org/mpl", "eclipse.org/legal", "vorbehalten", "reservados", "perl",
           "confidential"]
#: "cc" and "by" as words with anything but words between them; looked for only where "cc" occurs.
CC_BY = r"(?<![a-z0-9\x{80}-\x{10FFFF}])cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by(?![a-z0-9\x{80}-\x{10FFFF}])"

WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4, 5: 0.3}

TAGS = """
0bsd aal afl-3.0 agpl-3.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause
bsd-3-clause bsd-4-clause bsl-1.0 bzip2-1.0.6 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0 cc-by-nc-2.0 cc-by-nc-3.0
cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-2.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0 cc-by-nd-4.0
cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c cpal-1.0 cpl-1.0
curl ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 fsfap gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 icu ijg ipl-1.0 isc json
lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa nposl-3.0 odbl-1.0
ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 ruby sleepycat unicode-dfs-2016 unlicense upl-1.0 vim w3c
wtfpl x11 zlib zpl-2.1
""".split()

RULES = r"""
apache-2.0 | 1 | apache.org/licenses/license-2.0 | apache\.org/licenses/license-2\.0
apache-1.1 | 1 | apache.org/licenses/license-1.1 | apache\.org/licenses/license-1\.1
mit | 1 | opensource.org/licenses/mit | opensource\.org/licenses/mit>
mit | 1 | mit-license.org | mit-license\.org
bsd-2-clause | 1 | opensource.org/licenses/bsd-2-clause | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | 1 | opensource.org/licenses/bsd-3-clause | opensource\.org/licenses/bsd-3-clause
isc | 1 | opensource.org/licenses/isc | opensource\.org/licenses/isc>
gpl-2.0 | 1 | gnu.org/licenses/old-licenses/gpl-2.0 | gnu\.org/licenses/old-licenses/gpl-2\.0
gpl-3.0 | 1 | gnu.org/licenses/gpl-3.0 | gnu\.org/licenses/gpl-3\.0
gpl | 1 | gnu.org/licenses/gpl | gnu\.org/licenses/gpl(?:\.html|\.txt)?>
lgpl-2.1 | 1 | gnu.org/licenses/old-licenses/lgpl-2.1 | gnu\.org/licenses/old-licenses/lgpl-2\.1
lgpl-3.0 | 1 | gnu.org/licenses/lgpl-3.0 | gnu\.org/licenses/lgpl-3\.0
agpl-3.0 | 1 | gnu.org/licenses/agpl-3.0 | gnu\.org/licenses/agpl-3\.0
gfdl-1.3 | 1 | gnu.org/licenses/fdl-1.3 | gnu\.org/licenses/fdl-1\.3
mpl-2.0 | 1 | mozilla.org/mpl/2.0 | mozilla\.org/mpl/2\.0
epl-2.0 | 1 | eclipse.org/legal/epl-2.0 | eclipse\.org/legal/epl-2\.0
unlicense | 1 | unlicense.org | <unlicense\.org
wtfpl | 1 | wtfpl.net | <wtfpl\.net
cc-by-1.0 | 1 | creativecommons.org/licenses/by/1.0 | creativecommons\.org/licenses/by/1\.0
cc-by-2.0 | 1 | creativecommons.org/licenses/by/2.0 | creativecommons\.org/licenses/by/2\.0
cc-by-2.5 | 1 | creativecommons.org/licenses/by/2.5 | creativecommons\.org/licenses/by/2\.5
cc-by-3.0 | 1 | creativecommons.org/licenses/by/3.0 | creativecommons\.org/licenses/by/3\.0
cc-by-4.0 | 1 | creativecommons.org/licenses/by/4.0 | creativecommons\.org/licenses/by/4\.0
cc-by-sa-2.0 | 1 | creativecommons.org/licenses/by-sa/2.0 | creativecommons\.org/licenses/by-sa/2\.0
cc-by-sa-2.5 | 1 | creativecommons.org/licenses/by-sa/2.5 | creativecommons\.org/licenses/by-sa/2\.5
cc-by-sa-3.0 | 1 | creativecommons.org/licenses/by-sa/3.0 | creativecommons\.org/licenses/by-sa/3\.0
cc-by-sa-4.0 | 1 | creativecommons.org/licenses/by-sa/4.0 | creativecommons\.org/licenses/by-sa/4\.0
cc-by-nd-3.0 | 1 | creativecommons.org/licenses/by-nd/3.0 | creativecommons\.org/licenses/by-nd/3\.0
cc-by-nd-4.0 | 1 | creativecommons.org/licenses/by-nd/4.0 | creativecommons\.org/licenses/by-nd/4\.0
cc-by-nc-3.0 | 1 | creativecommons.org/licenses/by-nc/3.0 | creativecommons\.org/licenses/by-nc/3\.0
cc-by-nc-4.0 | 1 | creativecommons.org/licenses/by-nc/4.0 | creativecommons\.org/licenses/by-nc/4\.0
cc-by-nc-sa-3.0 | 1 | creativecommons.org/licenses/by-nc-sa/3.0 | creativecommons\.org/licenses/by-nc-sa/3\.0
cc-by-nc-sa-4.0 | 1 | creativecommons.org/licenses/by-nc-sa/4.0 | creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-3.0 | 1 | creativecommons.org/licenses/by-nc-nd/3.0 | creativecommons\.org/licenses/by-nc-nd/3\.0
cc-by-nc-nd-4.0 | 1 | creativecommons.org/licenses/by-nc-nd/4.0 | creativecommons\.org/licenses/by-nc-nd/4\.0
cc0-1.0 | 1 | creativecommons.org/publicdomain/zero/1.0 | creativecommons\.org/publicdomain/zero/1\.0
cc-pdm-1.0 | 1 | creativecommons.org/publicdomain/mark/1.0 | creativecommons\.org/publicdomain/mark/1\.0
cc-by-1.0 | 2 | by | <cc[~-]by[~-]1\.0>
cc-by-2.0 | 2 | by | <cc[~-]by[~-]2\.0>
cc-by-2.5 | 2 | by | <cc[~-]by[~-]2\.5>
cc-by-3.0 | 2 | by | <cc[~-]by[~-]3\.0>
cc-by-4.0 | 2 | by | <cc[~-]by[~-]4\.0>
cc-by-sa-2.0 | 2 | sa | <cc[~-]by[~-]sa[~-]2\.0>
cc-by-sa-2.5 | 2 | sa | <cc[~-]by[~-]sa[~-]2\.5>
cc-by-sa-3.0 | 2 | sa | <cc[~-]by[~-]sa[~-]3\.0>
cc-by-sa-4.0 | 2 | sa | <cc[~-]by[~-]sa[~-]4\.0>
cc-by-nd-3.0 | 2 | nd | <cc[~-]by[~-]nd[~-]3\.0>
cc-by-nd-4.0 | 2 | nd | <cc[~-]by[~-]nd[~-]4\.0>
cc-by-nc-2.0 | 2 | nc | <cc[~-]by[~-]nc[~-]2\.0>
cc-by-nc-3.0 | 2 | nc | <cc[~-]by[~-]nc[~-]3\.0>
cc-by-nc-4.0 | 2 | nc | <cc[~-]by[~-]nc[~-]4\.0>
cc-by-nc-sa-3.0 | 2 | nc | <cc[~-]by[~-]nc[~-]sa[~-]3\.0>
cc-by-nc-sa-4.0 | 2 | nc | <cc[~-]by[~-]nc[~-]sa[~-]4\.0>
cc-by-nc-nd-3.0 | 2 | nc | <cc[~-]by[~-]nc[~-]nd[~-]3\.0>
cc-by-nc-nd-4.0 | 2 | nc | <cc[~-]by[~-]nc[~-]nd[~-]4\.0>
cc0-1.0 | 2 | cc0 | <cc0[~-]+(?:v(?:ersion)?\.?~*)?1\.0>
cc-by-nc-nd | 3 | nc | <cc[~-]by[~-]nc[~-]nd>
cc-by-nc-sa | 3 | nc | <cc[~-]by[~-]nc[~-]sa>
cc-by-nc | 3 | nc | <cc[~-]by[~-]nc>
cc-by-sa | 3 | sa | <cc[~-]by[~-]sa>
cc-by-nd | 3 | nd | <cc[~-]by[~-]nd>
cc-by | 3 | by | <cc[~-]by>
cc0 | 3 | cc0 | <cc0>
cc-by-4.0 | 2 | creative commons | creative~+commons~+attribution~+(?:international~+(?:public~+)?licen[sc]e~+)?4\.0
cc-by-3.0 | 2 | creative commons | creative~+commons~+attribution~+3\.0
cc-by-2.5 | 2 | creative commons | creative~+commons~+attribution~+2\.5
cc-by-2.0 | 2 | creative commons | creative~+commons~+attribution~+2\.0
cc-by-sa-4.0 | 2 | creative commons | creative~+commons~+attribution[~-]+share[~-]?alike~+4\.0
cc-by-sa-3.0 | 2 | creative commons | creative~+commons~+attribution[~-]+share[~-]?alike~+3\.0
cc-by-nd-4.0 | 2 | creative commons | creative~+commons~+attribution[~-]+no[~-]?deriv(?:ative)?s~+4\.0
cc-by-nd-3.0 | 2 | creative commons | creative~+commons~+attribution[~-]+no[~-]?deriv(?:ative)?s~+3\.0
cc-by-nc-4.0 | 2 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial~+4\.0
cc-by-nc-3.0 | 2 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial~+3\.0
cc-by-nc-sa-4.0 | 2 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial[~-]+share[~-]?alike~+4\.0
cc-by-nc-sa-3.0 | 2 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial[~-]+share[~-]?alike~+3\.0
cc-by-nc-nd-4.0 | 2 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial[~-]+no[~-]?deriv(?:ative)?s~+4\.0
cc-by-nc-nd-3.0 | 2 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial[~-]+no[~-]?deriv(?:ative)?s~+3\.0
cc-by-sa | 3 | creative commons | creative~+commons~+attribution[~-]+share[~-]?alike
cc-by-nc | 3 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial
cc-by-nc-sa | 3 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial[~-]+share[~-]?alike
cc-by-nc-nd | 3 | creative commons | creative~+commons~+attribution[~-]+non[~-]?commercial[~-]+no[~-]?deriv(?:ative)?s
cc-by-nd | 3 | creative commons | creative~+commons~+attribution[~-]+no[~-]?deriv(?:ative)?s
cc-by | 3 | creative commons | creative~+commons~+attribution
cc0 | 3 | creative commons | creative~+commons~+(?:zero|public~+domain~+dedication)
creative-commons | 4 | creative commons | <creative~+commons>
apache-2.0 | 2 | apache | <apache~+(?:software~+)?licen[sc]e,?~*(?:version|v\.?)?~*2(?:\.0)?>
apache-1.1 | 2 | apache | <apache~+(?:software~+)?licen[sc]e,?~*(?:version|v\.?)?~*1\.1>
apache-1.0 | 2 | apache | <apache~+(?:software~+)?licen[sc]e,?~*(?:version|v\.?)?~*1\.0>
apache | 3 | apache | <apache~+(?:software~+|public~+)?licen[sc]e>
mit | 2 | mit | (?:licensed|released|distributed|available|published)~+under~+(?:the~+)?(?:terms~+of~+the~+)?mit~+licen[sc]e
mit | 3 | mit | <mit~+licen[sc]e>
mit | 3 | expat | <expat~+licen[sc]e>
mit-0 | 2 | no attribution | <mit~+no~+attribution~+licen[sc]e>
mit | 2 | permission is hereby granted, free of charge | permission~is~hereby~granted,~free~of~charge,~+to~+any~+person~+obtaining~+a~+copy
bsd-2-clause | 2 | bsd | <(?:bsd~+2[~-]clause|2[~-]clause~+bsd|two[~-]clause~+bsd|simplified~+bsd|freebsd)~+licen[sc]e>
bsd-3-clause | 2 | bsd | <(?:bsd~+3[~-]clause|3[~-]clause~+bsd|three[~-]clause~+bsd|new~+bsd|modified~+bsd|revised~+bsd)~+licen[sc]e>
bsd-4-clause | 2 | bsd | <(?:bsd~+4[~-]clause|4[~-]clause~+bsd|original~+bsd|old~+bsd)~+licen[sc]e>
0bsd | 2 | bsd | <(?:zero[~-]clause~+bsd|bsd~+zero[~-]clause|0bsd)~+licen[sc]e>
bsd | 3 | bsd | <bsd(?:[~-]style)?~+licen[sc]e>
isc | 3 | isc | <isc~+licen[sc]e>
gpl-3.0 | 2 | general public license | <(?:gnu~+)?general~public~license,?~*\(?(?:gpl\)?,?~*)?(?:version|v\.?)~*3(?:\.0)?>
gpl-2.0 | 2 | general public license | <(?:gnu~+)?general~public~license,?~*\(?(?:gpl\)?,?~*)?(?:version|v\.?)~*2(?:\.0)?>
gpl-1.0 | 2 | general public license | <(?:gnu~+)?general~public~license,?~*\(?(?:gpl\)?,?~*)?(?:version|v\.?)~*1(?:\.0)?>
gpl-3.0+ | 2 | any later version | <gnu~+general~+public~+licen[sc]e[\s\S]{0,120}?version~*3[\s\S]{0,60}?any~later~version
gpl-2.0+ | 2 | any later version | <gnu~+general~+public~+licen[sc]e[\s\S]{0,120}?version~*2[\s\S]{0,60}?any~later~version
gpl | 3 | general public license | <(?:gnu~+)?general~public~license>
lgpl-3.0 | 2 | lesser general public license | <(?:gnu~+)?lesser~general~public~license,?~*(?:version|v\.?)~*3(?:\.0)?>
lgpl-2.1 | 2 | lesser general public license | <(?:gnu~+)?lesser~general~public~license,?~*(?:version|v\.?)~*2\.1>
lgpl-2.0 | 2 | library general public license | <(?:gnu~+)?library~general~public~license,?~*(?:version|v\.?)~*2(?:\.0)?>
lgpl | 3 | general public license | <(?:gnu~+)?(?:lesser|library)~general~public~license>
agpl-3.0 | 2 | affero general public license | <(?:gnu~+)?affero~general~public~license,?~*(?:version|v\.?)~*3(?:\.0)?>
agpl | 3 | affero general public license | <(?:gnu~+)?affero~general~public~license>
gpl-3.0 | 2 | gpl | <(?:gnu~+)?gpl[~-]?v?3(?:\.0)?>
gpl-2.0 | 2 | gpl | <(?:gnu~+)?gpl[~-]?v?2(?:\.0)?>
lgpl-3.0 | 2 | lgpl | <(?:gnu~+)?lgpl[~-]?v?3(?:\.0)?>
lgpl-2.1 | 2 | lgpl | <(?:gnu~+)?lgpl[~-]?v?2\.1>
agpl-3.0 | 2 | agpl | <(?:gnu~+)?agpl[~-]?v?3(?:\.0)?>
gpl | 3 | gpl | <gpl>
lgpl | 3 | lgpl | <lgpl>
agpl | 3 | agpl | <agpl>
gfdl-1.3 | 2 | free documentation | <(?:gnu~+)?free~+documentation~+licen[sc]e,?~*(?:version|v\.?)~*1\.3>
gfdl-1.2 | 2 | free documentation | <(?:gnu~+)?free~+documentation~+licen[sc]e,?~*(?:version|v\.?)~*1\.2>
gfdl-1.1 | 2 | free documentation | <(?:gnu~+)?free~+documentation~+licen[sc]e,?~*(?:version|v\.?)~*1\.1>
gfdl | 3 | free documentation | <(?:gnu~+)?free~+documentation~+licen[sc]e>
mpl-2.0 | 2 | mozilla | <mozilla~+public~+licen[sc]e,?~*(?:version|v\.?)?~*2\.0>
mpl-1.1 | 2 | mozilla | <mozilla~+public~+licen[sc]e,?~*(?:version|v\.?)?~*1\.1>
mpl-1.0 | 2 | mozilla | <mozilla~+public~+licen[sc]e,?~*(?:version|v\.?)?~*1\.0>
mpl | 3 | mozilla | <mozilla~+public~+licen[sc]e>
epl-2.0 | 2 | eclipse | <eclipse~+public~+licen[sc]e,?~*(?:-~*)?(?:version|v\.?)?~*2\.0>
epl-1.0 | 2 | eclipse | <eclipse~+public~+licen[sc]e,?~*(?:-~*)?(?:version|v\.?)?~*1\.0>
epl | 3 | eclipse | <eclipse~+public~+licen[sc]e>
edl-1.0 | 3 | eclipse | <eclipse~+distribution~+licen[sc]e>
eupl-1.2 | 2 | european union | <european~+union~+public~+licen[sc]e,?~*(?:version|v\.?)?~*1\.2>
eupl-1.1 | 2 | european union | <european~+union~+public~+licen[sc]e,?~*(?:version|v\.?)?~*1\.1>
eupl | 3 | european union | <european~+union~+public~+licen[sc]e>
cddl-1.1 | 2 | common development | <common~+development~+and~+distribution~+licen[sc]e,?~*(?:\(cddl\),?~*)?(?:version|v\.?)?~*1\.1>
cddl-1.0 | 2 | common development | <common~+development~+and~+distribution~+licen[sc]e,?~*(?:\(cddl\),?~*)?(?:version|v\.?)?~*1\.0>
cddl | 3 | common development | <common~+development~+and~+distribution~+licen[sc]e>
cpl-1.0 | 3 | common public | <common~+public~+licen[sc]e>
cpal-1.0 | 3 | common public attribution | <common~+public~+attribution~+licen[sc]e>
ipl-1.0 | 3 | ibm public | <ibm~+public~+licen[sc]e>
apsl-2.0 | 2 | apple public source | <apple~+public~+source~+licen[sc]e,?~*(?:version|v\.?)?~*2\.0>
apsl | 3 | apple public source | <apple~+public~+source~+licen[sc]e>
artistic-2.0 | 2 | artistic | <artistic~+licen[sc]e,?~*(?:version|v\.?)?~*2\.0>
artistic-1.0 | 2 | artistic | <artistic~+licen[sc]e,?~*(?:version|v\.?)?~*1\.0>
artistic | 3 | artistic | <artistic~+licen[sc]e>
bsl-1.0 | 3 | boost | <boost~+software~+licen[sc]e>
busl-1.1 | 3 | business source | <business~+source~+licen[sc]e>
zlib | 3 | zlib | <zlib(?:/libpng)?~+licen[sc]e>
libpng | 3 | libpng | <libpng~+licen[sc]e>
openssl | 3 | openssl | <openssl~+licen[sc]e>
python-2.0 | 3 | python | <python~+(?:software~+foundation~+)?licen[sc]e>
php-3.01 | 3 | php | <php~+licen[sc]e>
ruby | 3 | ruby | <ruby~+licen[sc]e>
perl | 3 | perl itself | <same~+terms~+as~+perl~itself
postgresql | 3 | postgresql | <postgresql~+licen[sc]e>
ms-pl | 3 | microsoft public | <microsoft~+public~+licen[sc]e>
ms-rl | 3 | microsoft reciprocal | <microsoft~+reciprocal~+licen[sc]e>
ncsa | 3 | ncsa | <(?:university~+of~+illinois/)?ncsa~+(?:open~+source~+)?licen[sc]e>
ofl-1.1 | 2 | open font | <(?:sil~+)?open~+font~+licen[sc]e,?~*(?:version|v\.?)?~*1\.1>
ofl | 3 | open font | <(?:sil~+)?open~+font~+licen[sc]e>
osl-3.0 | 3 | open software | <open~+software~+licen[sc]e>
afl-3.0 | 3 | academic free | <academic~+free~+licen[sc]e>
ecl-2.0 | 3 | educational community | <educational~+community~+licen[sc]e>
odbl-1.0 | 3 | open database | <open~+database~+licen[sc]e>
odc-by-1.0 | 3 | open data commons | <open~+data~+commons~+attribution~+licen[sc]e>
pddl-1.0 | 3 | open data commons | <open~+data~+commons~+public~+domain~+dedication~+and~+licen[sc]e>
ogl-uk-3.0 | 2 | open government | <open~+government~+licen[sc]e,?~*(?:for~+public~+sector~+information~*)?(?:version|v\.?)?~*3\.0>
ogl | 3 | open government | <open~+government~+licen[sc]e>
lppl-1.3c | 3 | latex project | <latex~+project~+public~+licen[sc]e>
qpl-1.0 | 3 | q public | <q~+public~+licen[sc]e>
sleepycat | 3 | sleepycat | <sleepycat~+licen[sc]e>
sspl-1.0 | 3 | server side public | <server~+side~+public~+licen[sc]e>
elastic-2.0 | 3 | elastic | <elastic~+licen[sc]e>
commons-clause | 3 | commons clause | <commons~+clause~+licen[sc]e>
upl-1.0 | 3 | universal permissive | <universal~+permissive~+licen[sc]e>
vim | 3 | vim | <vim~+licen[sc]e>
w3c | 3 | w3c | <w3c~+(?:software~+(?:notice~+and~+)?)?licen[sc]e>
x11 | 3 | x11 | <x11~+licen[sc]e>
zpl-2.1 | 3 | zope | <zope~+public~+licen[sc]e>
unicode | 3 | unicode | <unicode~+(?:inc\.?~+)?licen[sc]e~+agreement>
icu | 3 | icu | <icu~+licen[sc]e>
curl | 3 | curl | <curl~+licen[sc]e>
json | 3 | json | <json~+licen[sc]e>
beerware | 3 | beer | <beer-?ware~+licen[sc]e>
wtfpl | 3 | wtfpl | <wtfpl>
unlicense | 3 | unlicense | <(?:the~+)?unlicense>
cecill | 3 | cecill | <cecill(?:-[bc])?~+(?:free~+software~+)?licen[sc]e
mulanpsl | 3 | mulan | <mulan~+permissive~+software~+licen[sc]e>
blueoak | 3 | blue oak | <blue~+oak~+model~+licen[sc]e>
oldap | 3 | openldap | <openldap~+public~+licen[sc]e>
intel | 3 | intel | <intel~+(?:simplified~+)?(?:software|open~+source)~+licen[sc]e>
nvidia | 3 | nvidia | <nvidia~+(?:source~+code~+|software~+)?licen[sc]e>
llama | 3 | llama | <llama~+[0-9.]*~*community~+licen[sc]e>
openrail | 3 | openrail | <(?:creativeml~+|bigscience~+)?openrail(?:-?m)?~+licen[sc]e
rail | 3 | responsible ai | <responsible~+ai~+licen[sc]e
gpl | 3 | licence publique | <licence~+publique~+g[eé]n[eé]rale~+gnu
gpl | 3 | licencia p | <licencia~+p[uú]blica~+general(?:~+de)?~+gnu
cc-by | 3 | creative commons | <creative~+commons~+(?:paternit[eé]|namensnennung|atribuci[oó]n)
public-domain | 3 | public domain | (?:placed~+in|dedicated~+to|released~+(?:in)?to)~+the~+public~domain
public-domain | 4 | public domain | <public~domain>
proprietary | 3 | proprietary | <proprietary~+(?:software~+)?licen[sc]e
proprietary | 3 | confidential | <confidential~+and~+proprietary[\s\S]{0,80}(?:copyright|licen[sc]e|all~+rights)
commercial | 3 | commercial | <commercial~+licen[sc]e>
evaluation | 3 | evaluation | <evaluation~+licen[sc]e>
eula | 3 | end user | <end[~-]user~+licen[sc]e~+agreement
no-warranty | 4 | warranty | without~+(?:any~+)?(?:express~+or~+implied~+)?warranty>
no-warranty | 4 | as is | provided~+["'“]?as~is["'”]?,?~+without~+warranty
reserved | 4 | all rights reserved | <all~rights~reserved>
reserved | 4 | derechos reservados | <todos~+los~+derechos~reservados
reserved | 4 | rechte vorbehalten | <alle~+rechte~vorbehalten
copyright | 4 | copyright | <copyright~*(?:\(c\)|©)?~*(?:19|20)[0-9][0-9]>
copyright | 4 | (c) | \(c\)~*(?:19|20)[0-9][0-9]>
copyright | 4 | © | ©~*(?:19|20)[0-9][0-9]>
unknown | 5 | licen | (?:licensed|released|distributed)~+under~+(?:the~+)?(?:terms~+of~+)?[a-z0-9][^.;]{0,60}?licen[sc]e>
unknown | 5 | see the licen | <see~+the~licen[sc]e~+(?:file|for~+the~+specific)
"""


@dataclass(frozen=True)
class Rule:
    """``order`` ranks rules of one priority: earlier lines win."""

    order: int
    label: str
    priority: int
    keywords: tuple[str, ...]
    pattern: str

    @property
    def weight(self) -> float:
        return WEIGHTS[self.priority]


def _pattern(text: str) -> str:
    text = re.sub(r"~(?![+*?-])", "~+", text.replace("[~-]", r"[\s-]")).replace("~", r"\s")
    return text.replace("<", r"(?<![a-z0-9])").replace(">", r"(?![a-z0-9])")


def rules() -> list[Rule]:
    out = []
    for tag in TAGS:
        pattern = r"spdx-license-identifier:\s*" + tag.replace(".", r"\.") + r"(?:-only|-or-later|\+)?(?![a-z0-9.-])"
        out.append((tag, 1, ("spdx-license-identifier",), pattern))
    for line in RULES.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ", 3)
        out.append((label, int(priority), tuple(keyword.split()), _pattern(pattern)))
    return [Rule(i, *x) for i, x in enumerate(out)]
