"""License scans by ordered signature rules, with DataFrame operations only.

A text is matched as words: A-Z in lower case, everything but digits, letters and characters
beyond ASCII taken as a blank. A keyword expression on the raw text lets past only texts that a
rule could match; in those, each rule whose own keyword occurs runs its expression. Every match
is an interval of the normalised text with the rule's priority. A match that lies within another
one is dropped if that other has a higher priority, or the same one and more text, or the same
interval and an earlier rule. The labels that remain are the method's.

The base phrases are places of fixed words; they are counted apart and their labels always stay.

Null texts have no words; texts without a place have null first and last words, empty labels and
score 0; each row is scanned by itself, so ties, repeated rows and null ids need no rule. Other
columns pass by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrase -> label of the base scan.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Hand-written signatures: label | priority | confidence in percent | keyword | expression over
#: the normalised words. A higher priority wins over what it contains.
SIGNATURES = r"""
apache-2.0 | 90 | 98 | apache | licensed under the apache licen[cs]e(?: version)? 2 0
apache-2.0 | 90 | 95 | apache | apache licen[cs]e(?: version| v)? 2(?: 0)?
apache-2.0 | 85 | 90 | apache | www apache org licenses license 2 0
apache-2.0 | 80 | 80 | apache | apache 2(?: 0)? licen[cs]ed?
apache-1.1 | 90 | 95 | apache | apache (?:software )?licen[cs]e(?: version| v)? 1 1
apache-1.0 | 90 | 95 | apache | apache (?:software )?licen[cs]e(?: version| v)? 1 0
apache | 40 | 60 | apache | apache (?:software )?licen[cs]e
mit | 90 | 98 | mit | (?:released|licensed|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e
mit | 70 | 90 | mit | the mit licen[cs]e
mit | 60 | 80 | mit | mit licen[cs]ed?
mit | 90 | 97 | permission is hereby | permission is hereby granted free of charge to any person obtaining a copy of this software
mit | 85 | 90 | opensource | opensource org licenses mit
x11 | 80 | 90 | x11 | x11 licen[cs]e
expat | 80 | 90 | expat | expat licen[cs]e
gpl-3.0 | 90 | 98 | general public | licensed under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3(?: 0)?
gpl-3.0 | 85 | 95 | general public | gnu general public licen[cs]e(?: version| v)? 3(?: 0)?
gpl-3.0 | 80 | 90 | gpl | gpl(?: version| v)? ?3(?: 0)?
gpl-3.0 | 80 | 90 | gplv3 | gplv3
gpl-2.0 | 90 | 98 | general public | licensed under (?:the )?(?:terms of )?(?:the )?gnu general public licen[cs]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2(?: 0)?
gpl-2.0 | 85 | 95 | general public | gnu general public licen[cs]e(?: version| v)? 2(?: 0)?
gpl-2.0 | 80 | 90 | gpl | gpl(?: version| v)? ?2(?: 0)?
gpl-2.0 | 80 | 90 | gplv2 | gplv2
gpl-1.0 | 85 | 95 | general public | gnu general public licen[cs]e(?: version| v)? 1(?: 0)?
gpl | 40 | 70 | general public | gnu general public licen[cs]e
gpl | 35 | 60 | gnu gpl | gnu gpl
gpl | 30 | 60 | general public | general public licen[cs]e
lgpl-3.0 | 95 | 98 | lesser general | (?:gnu )?lesser general public licen[cs]e(?: version| v)? 3(?: 0)?
lgpl-2.1 | 95 | 98 | lesser general | (?:gnu )?lesser general public licen[cs]e(?: version| v)? 2 1
lgpl-2.0 | 95 | 98 | library general | (?:gnu )?library general public licen[cs]e(?: version| v)? 2(?: 0)?
lgpl | 60 | 80 | lesser general | (?:gnu )?lesser general public licen[cs]e
lgpl | 60 | 80 | library general | (?:gnu )?library general public licen[cs]e
lgpl-3.0 | 80 | 90 | lgplv3 | lgplv3
lgpl-2.1 | 80 | 90 | lgplv2 | lgplv2(?: 1)?
lgpl-3.0 | 82 | 90 | lgpl | lgpl(?: version| v)? ?3(?: 0)?
lgpl-2.1 | 82 | 90 | lgpl | lgpl(?: version| v)? ?2 1
agpl-3.0 | 95 | 98 | affero | (?:gnu )?affero general public licen[cs]e(?: version| v)? 3(?: 0)?
agpl-1.0 | 95 | 98 | affero | affero general public licen[cs]e(?: version| v)? 1(?: 0)?
agpl | 60 | 80 | affero | (?:gnu )?affero general public licen[cs]e
agpl-3.0 | 80 | 90 | agpl | agpl ?v? ?3(?: 0)?
agpl-3.0 | 80 | 90 | agplv3 | agplv3
fdl-1.3 | 90 | 95 | free documentation | gnu free documentation licen[cs]e(?: version| v)? 1 3
fdl-1.2 | 90 | 95 | free documentation | gnu free documentation licen[cs]e(?: version| v)? 1 2
fdl-1.1 | 90 | 95 | free documentation | gnu free documentation licen[cs]e(?: version| v)? 1 1
fdl | 50 | 70 | free documentation | (?:gnu )?free documentation licen[cs]e
bsd-2-clause | 90 | 95 | bsd | (?:simplified bsd licen[cs]e|bsd 2 clause(?: licen[cs]e)?|2 clause bsd(?: licen[cs]e)?)
bsd-3-clause | 90 | 95 | bsd | (?:new bsd licen[cs]e|modified bsd licen[cs]e|revised bsd licen[cs]e|bsd 3 clause(?: licen[cs]e)?|3 clause bsd(?: licen[cs]e)?)
bsd-4-clause | 90 | 95 | bsd | (?:original bsd licen[cs]e|bsd 4 clause(?: licen[cs]e)?|4 clause bsd(?: licen[cs]e)?)
bsd-0-clause | 90 | 95 | bsd | (?:zero clause bsd(?: licen[cs]e)?|bsd zero clause(?: licen[cs]e)?|0bsd)
bsd-clear | 91 | 95 | bsd | (?:clear bsd licen[cs]e|bsd 3 clause clear(?: licen[cs]e)?)
bsd | 40 | 70 | bsd | bsd (?:style )?licen[cs]e
bsd | 60 | 75 | redistribution and use | redistribution and use in source and binary forms with or without modification are permitted
mpl-2.0 | 90 | 98 | mozilla | mozilla public licen[cs]e(?: version| v)? 2(?: 0)?
mpl-1.1 | 90 | 98 | mozilla | mozilla public licen[cs]e(?: version| v)? 1 1
mpl-1.0 | 90 | 98 | mozilla | mozilla public licen[cs]e(?: version| v)? 1 0
mpl | 40 | 70 | mozilla | mozilla public licen[cs]e
mpl-2.0 | 80 | 90 | mozilla org | mozilla org mpl 2 0
npl | 60 | 80 | netscape | netscape public licen[cs]e
epl-2.0 | 90 | 98 | eclipse | eclipse public licen[cs]e(?: version| v)? 2(?: 0)?
epl-1.0 | 90 | 98 | eclipse | eclipse public licen[cs]e(?: version| v)? 1(?: 0)?
epl | 40 | 70 | eclipse | eclipse public licen[cs]e
edl-1.0 | 80 | 90 | eclipse | eclipse distribution licen[cs]e(?: version| v)? 1(?: 0)?
cddl-1.1 | 90 | 95 | common development | common development and distribution licen[cs]e(?: version| v)? 1 1
cddl-1.0 | 90 | 95 | common development | common development and distribution licen[cs]e(?: version| v)? 1(?: 0)?
cddl | 40 | 70 | common development | common development and distribution licen[cs]e
cpl-1.0 | 80 | 90 | common public | common public licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
cpal-1.0 | 90 | 95 | common public | common public attribution licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
ipl-1.0 | 80 | 90 | ibm public | ibm public licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
isc | 80 | 90 | isc | (?:the )?isc licen[cs]e
isc | 70 | 85 | permission to use | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | 80 | 90 | zlib | (?:zlib licen[cs]e|zlib libpng licen[cs]e)
libpng | 70 | 85 | libpng | libpng licen[cs]e
unlicense | 80 | 95 | unlicense | (?:the unlicense|unlicense org)
unlicense | 80 | 95 | unencumbered | this is free and unencumbered software released into the public domain
public-domain | 50 | 80 | public domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
public-domain | 40 | 60 | public domain | (?:is|are) in the public domain
wtfpl | 80 | 95 | wtfpl | wtfpl
wtfpl | 80 | 95 | what the f | do what the f[a-z]* you want to public licen[cs]e
artistic-2.0 | 90 | 95 | artistic | artistic licen[cs]e(?: version| v)? 2(?: 0)?
artistic-1.0 | 90 | 95 | artistic | artistic licen[cs]e(?: version| v)? 1(?: 0)?
artistic | 40 | 70 | artistic | (?:perl )?artistic licen[cs]e
perl | 70 | 85 | same terms as perl | under the same terms as perl itself
boost-1.0 | 90 | 95 | boost | boost software licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
python-2.0 | 80 | 90 | python | python software foundation licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
python-2.0 | 80 | 90 | psf | psf licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
ruby | 60 | 80 | ruby | ruby licen[cs]e
php-3.01 | 90 | 95 | php | php licen[cs]e(?: version| v)? 3 01
php-3.0 | 80 | 90 | php | php licen[cs]e(?: version| v)? 3(?: 0)?
openssl | 80 | 90 | openssl | openssl licen[cs]e
curl | 70 | 85 | curl | curl licen[cs]e
ofl-1.1 | 90 | 95 | open font | (?:sil )?open font licen[cs]e(?: version| v)?(?: 1 1)?
ofl-1.0 | 91 | 95 | open font | (?:sil )?open font licen[cs]e(?: version| v)? 1 0
eupl-1.2 | 90 | 95 | european union public | european union public licen[cs]e(?: version| v)? 1 2
eupl-1.1 | 90 | 95 | european union public | european union public licen[cs]e(?: version| v)? 1 1
eupl | 40 | 70 | european union public | european union public licen[cs]e
cecill-2.1 | 90 | 95 | cecill | cecill licen[cs]e(?: version| v)? 2 1
cecill | 40 | 70 | cecill | cecill(?: [bc])? licen[cs]e
ms-pl | 80 | 90 | microsoft | microsoft public licen[cs]e
ms-rl | 80 | 90 | microsoft | microsoft reciprocal licen[cs]e
osl-3.0 | 80 | 90 | open software | open software licen[cs]e(?: version| v)?(?: 3(?: 0)?)?
afl-3.0 | 80 | 90 | academic free | academic free licen[cs]e(?: version| v)?(?: 3(?: 0)?)?
ncsa | 80 | 90 | ncsa | (?:university of illinois )?ncsa open source licen[cs]e
postgresql | 80 | 90 | postgresql | postgresql licen[cs]e
vim | 60 | 80 | vim | vim licen[cs]e
sspl-1.0 | 80 | 90 | server side public | server side public licen[cs]e(?: version| v)?(?: 1)?
elastic-2.0 | 80 | 90 | elastic | elastic licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
busl-1.1 | 80 | 90 | business source | business source licen[cs]e(?: version| v)?(?: 1 1)?
odbl-1.0 | 80 | 90 | open database | (?:odc )?open database licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
odc-by-1.0 | 80 | 90 | open data commons | open data commons attribution licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
pddl-1.0 | 80 | 90 | public domain dedication | public domain dedication and licen[cs]e
ogl-3.0 | 80 | 90 | open government | open government licen[cs]e(?: version| v)?(?: 3(?: 0)?)?
rail | 70 | 85 | responsible ai | responsible ai licen[cs]e
cc0-1.0 | 95 | 97 | cc0 | cc0(?: 1 0)?(?: universal)?
cc0-1.0 | 95 | 97 | creative commons | creative commons (?:cc0|zero)(?: 1 0)?
cc-by-nc-nd | 96 | 97 | cc by nc nd | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | 96 | 97 | cc by nc sa | cc by nc sa(?: [1-4] [05])?
cc-by-nc | 94 | 97 | cc by nc | cc by nc(?: [1-4] [05])?
cc-by-nd | 94 | 97 | cc by nd | cc by nd(?: [1-4] [05])?
cc-by-sa | 94 | 97 | cc by sa | cc by sa(?: [1-4] [05])?
cc-by | 90 | 95 | cc by | cc by(?: [1-4] [05])?
cc-by-nc-nd | 96 | 97 | creative commons | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-sa | 96 | 97 | creative commons | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc | 94 | 97 | creative commons | creative commons attribution non ?commercial(?: [1-4] [05])?
cc-by-nd | 94 | 97 | creative commons | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-sa | 94 | 97 | creative commons | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by | 90 | 95 | creative commons | creative commons attribution(?: [1-4] [05])?
cc | 40 | 60 | creative commons | creative commons(?: public)? licen[cs]e
cc-by-nc-nd | 93 | 95 | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
cc-by-nc-sa | 93 | 95 | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc | 92 | 95 | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nd | 92 | 95 | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-sa | 92 | 95 | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by | 91 | 95 | creativecommons | creativecommons org licenses by [1-4] [05]
cc0-1.0 | 91 | 95 | creativecommons | creativecommons org publicdomain zero 1 0
reserved | 30 | 70 | rights reserved | (?:all )?rights reserved
reserved | 50 | 80 | may not be reproduced | (?:no part of this [a-z]+ )?may not be reproduced
proprietary | 50 | 80 | proprietary | proprietary (?:and confidential|licen[cs]e|software)
copyright | 20 | 50 | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
eula | 50 | 80 | end user licen | end user licen[cs]e agreement
afl-2.1 | 85 | 92 | academic free | academic free licen[cs]e(?: version| v)? 2 1
afl-1.2 | 85 | 92 | academic free | academic free licen[cs]e(?: version| v)? 1 2
osl-2.1 | 85 | 92 | open software | open software licen[cs]e(?: version| v)? 2 1
osl-1.0 | 85 | 92 | open software | open software licen[cs]e(?: version| v)? 1(?: 0)?
rpl-1.5 | 85 | 92 | reciprocal public | reciprocal public licen[cs]e(?: version| v)?(?: 1 5)?
apsl-2.0 | 85 | 92 | apple public source | apple public source licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
sissl | 80 | 90 | sun industry | sun industry standards source licen[cs]e
spl-1.0 | 80 | 90 | sun public | sun public licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
qpl-1.0 | 80 | 90 | q public | q public licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
lppl-1.3 | 90 | 95 | latex project | latex project public licen[cs]e(?: version| v)? 1 3[ac]?
lppl | 60 | 80 | latex project | latex project public licen[cs]e
ecl-2.0 | 85 | 92 | educational community | educational community licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
upl-1.0 | 85 | 92 | universal permissive | universal permissive licen[cs]e(?: version| v)?(?: 1(?: 0)?)?
w3c | 80 | 90 | w3c | w3c software (?:and document )?(?:notice and )?licen[cs]e
zpl-2.1 | 90 | 95 | zope | zope public licen[cs]e(?: version| v)? 2 1
zpl | 60 | 80 | zope | zope public licen[cs]e
unicode | 80 | 90 | unicode | unicode (?:inc )?licen[cs]e agreement
icu | 80 | 90 | icu | icu licen[cs]e
ibm-pibs | 80 | 90 | ibm powerpc | ibm powerpc initialization and boot software licen[cs]e
bittorrent | 80 | 90 | bittorrent | bittorrent open source licen[cs]e
sleepycat | 80 | 90 | sleepycat | sleepycat licen[cs]e
tcl | 70 | 85 | tcl | tcl(?: tk)? licen[cs]e
jasper | 80 | 90 | jasper | jasper licen[cs]e
imagemagick | 80 | 90 | imagemagick | imagemagick licen[cs]e
freetype | 80 | 90 | freetype | freetype (?:project )?licen[cs]e
ijg | 80 | 90 | jpeg | independent jpeg group licen[cs]e
libtiff | 80 | 90 | libtiff | libtiff licen[cs]e
info-zip | 80 | 90 | info zip | info zip licen[cs]e
hpnd | 80 | 90 | historical permission | historical permission notice and disclaimer licen[cs]e
beerware | 80 | 90 | beer | beer ?ware licen[cs]e
json | 70 | 85 | json | (?:the )?json licen[cs]e
naumen | 80 | 90 | naumen | naumen public licen[cs]e
nokia | 80 | 90 | nokia | nokia open source licen[cs]e
intel | 70 | 85 | intel | intel open source licen[cs]e
sgi-b-2.0 | 85 | 92 | sgi free | sgi free software licen[cs]e b(?: version| v)?(?: 2(?: 0)?)?
motosoto | 80 | 90 | motosoto | motosoto open source licen[cs]e
mulan-2.0 | 85 | 92 | mulan | mulan (?:permissive software|psl) licen[cs]e(?: version| v)?(?: 2(?: 0)?)?
mulan-2.0 | 85 | 92 | mulan | mulan psl ?v2 licen[cs]e
bluoak-1.0 | 85 | 92 | blue oak | blue oak model licen[cs]e(?: version| v)?(?: 1 0(?: 0)?)?
parity-7.0 | 85 | 92 | parity | parity public licen[cs]e(?: version| v)?(?: 7 0(?: 0)?)?
polyform-noncommercial-1.0 | 90 | 95 | polyform | polyform noncommercial licen[cs]e(?: version| v)?(?: 1 0(?: 0)?)?
polyform-small-business-1.0 | 90 | 95 | polyform | polyform small business licen[cs]e(?: version| v)?(?: 1 0(?: 0)?)?
polyform | 50 | 75 | polyform | polyform [a-z]+ licen[cs]e
hippocratic-2.1 | 85 | 92 | hippocratic | hippocratic licen[cs]e(?: version| v)?(?: 2 1)?
commons-clause | 80 | 90 | commons clause | commons clause (?:restriction )?licen[cs]e(?: condition)?
fsl-1.1 | 85 | 92 | functional source | functional source licen[cs]e(?: version| v)?(?: 1 1)?
confluent-1.0 | 85 | 92 | confluent community | confluent community licen[cs]e(?: agreement)?(?: version| v)?(?: 1 0)?
timescale | 80 | 90 | timescale | timescale licen[cs]e(?: agreement)?
redis-sal | 80 | 90 | redis source | redis source available licen[cs]e
openrail | 85 | 92 | openrail | (?:creativeml |bigscience )?open ?rail(?: m| s)? licen[cs]e
bigscience-rail-1.0 | 88 | 93 | bigscience | bigscience rail licen[cs]e(?: version| v)?(?: 1 0)?
llama | 80 | 90 | llama | llama (?:[234] )?community licen[cs]e
gemma | 70 | 85 | gemma | gemma licen[cs]e
cdla-permissive-2.0 | 90 | 95 | community data | community data licen[cs]e agreement permissive(?: version| v)?(?: 2 0)?
cdla-permissive-1.0 | 91 | 95 | community data | community data licen[cs]e agreement permissive(?: version| v)? 1 0
cdla-sharing-1.0 | 90 | 95 | community data | community data licen[cs]e agreement sharing(?: version| v)?(?: 1 0)?
dbcl-1.0 | 85 | 92 | database contents | (?:odc )?database contents licen[cs]e(?: version| v)?(?: 1 0)?
etalab-2.0 | 80 | 90 | etalab | etalab open licen[cs]e(?: version| v)?(?: 2 0)?
dl-de-by-2.0 | 80 | 90 | data licence germany | data licen[cs]e germany attribution(?: version| v)?(?: 2 0)?
ogl-canada-2.0 | 85 | 92 | canada | open government licen[cs]e canada(?: version| v)?(?: 2 0)?
ogl-1.0 | 85 | 92 | open government | open government licen[cs]e(?: version| v)? 1(?: 0)?
ogl-2.0 | 85 | 92 | open government | open government licen[cs]e(?: version| v)? 2(?: 0)?
free-art-1.3 | 80 | 90 | free art | free art licen[cs]e(?: version| v)?(?: 1 3)?
cern-ohl-p-2.0 | 90 | 95 | cern | cern open hardware licen[cs]e(?: version| v)? 2 permissive
cern-ohl-s-2.0 | 90 | 95 | cern | cern open hardware licen[cs]e(?: version| v)? 2 strongly reciprocal
cern-ohl | 60 | 80 | cern | cern open hardware licen[cs]e
solderpad-2.1 | 85 | 92 | solderpad | solderpad hardware licen[cs]e(?: version| v)?(?: 2 1)?
tapr-ohl | 80 | 90 | tapr | tapr open hardware licen[cs]e
dsl | 70 | 85 | design science | design science licen[cs]e
opl | 60 | 80 | open publication | open publication licen[cs]e
ubuntu-font-1.0 | 85 | 92 | ubuntu font | ubuntu font licen[cs]e(?: version| v)?(?: 1 0)?
bitstream-vera | 80 | 90 | bitstream vera | bitstream vera (?:fonts )?licen[cs]e
eula | 45 | 75 | software licen | (?:this )?software licen[cs]e agreement
all-permissive | 80 | 90 | copying and distribution of this file | copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice
"""

#: Identifiers behind "SPDX-License-Identifier"; their rules follow from the names.
IDENTIFIERS = """
0bsd afl-3.0 agpl-3.0 apache-1.1 apache-2.0 artistic-1.0 artistic-2.0 boost-1.0 bsd-2-clause bsd-3-clause
bsd-4-clause busl-1.1 cc-by-3.0 cc-by-4.0 cc-by-nc-4.0 cc-by-nc-nd-4.0 cc-by-nc-sa-4.0 cc-by-nd-4.0 cc-by-sa-3.0
cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1
eupl-1.2 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 libpng mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl
ms-rl ncsa odbl-1.0 ofl-1.0 ofl-1.1 openssl osl-3.0 pddl-1.0 php-3.0 php-3.01 postgresql python-2.0 unlicense
upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1
""".split()


def rules() -> list[tuple[int, str, int, float, str, str]]:
    """(order, label, priority, confidence, keyword, expression)."""
    found = []
    for line in SIGNATURES.strip().splitlines():
        label, priority, percent, keyword, expression = (x.strip() for x in line.split(" | "))
        found.append((label, int(priority), int(percent) / 100, keyword, expression))
    for name in IDENTIFIERS:
        words = name.replace("-", " ").replace(".", " ")
        found.append((name, 100 + len(words), 1.0, "spdx", f"spdx licen[cs]e identifier {words}(?: only| or later)?"))
    return [(k, label, p, c, keyword, rf"(?<= ){e}(?= )") for k, (label, p, c, keyword, e) in enumerate(found)]


def normalised(text: Column) -> Column:
    """Lower-case words between single blanks, with a blank at either end."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, _UPPER, _LOWER), _NO_WORD, " ")), F.lit(" "))


#: Fragments of which every text that a rule or phrase matches holds one; few, so that the gate
#: is one cheap expression. A test derives from the rules that none is missing.
FRAGMENTS = (
    "licen", "cc", "gpl", "public", "reserved", "copyright", "spdx", "permission", "redistribution", "proprietary",
    "reproduced", "unencumbered", "wtfpl", "bsd", "commons", "perl", "mozilla",
)


def _gate() -> str:
    """Raw texts with a fragment; "cc" only as it stands in the rules."""
    first = "".join(sorted({f[0] for f in FRAGMENTS}))
    forms = [f if f != "cc" else f"cc(?:0|{_NO_WORD}by)" for f in FRAGMENTS]
    return f"(?i)(?=[{first}])(?:{'|'.join(forms)})"


def _blanks(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _spans(norm: Column, rule: Column) -> Column:
    """Intervals of a rule's matches: from the lengths of the matches and of what is between."""
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,b:int>>").alias("spans"))
    sizes = F.zip_with(
        F.transform(F.split(norm, rule["expression"], -1), F.length),
        F.transform(F.regexp_extract_all(norm, rule["expression"], F.lit(0)), F.length),
        lambda gap, match: F.struct(F.coalesce(gap, F.lit(0)).alias("gap"), match.alias("match")),
    )
    add = lambda s, x: F.struct(
        (s["at"] + x["gap"] + F.coalesce(x["match"], F.lit(0))).alias("at"),
        F.when(x["match"].isNull(), s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct((s["at"] + x["gap"]).alias("a"), (s["at"] + x["gap"] + x["match"]).alias("b"))))).alias("spans"),
    )
    return F.transform(
        F.aggregate(sizes, step, add)["spans"],
        lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"), rule["priority"].alias("priority"), rule["k"].alias("k"), rule["label"].alias("label"), rule["confidence"].alias("confidence")),
    )


def scan(df: DataFrame) -> DataFrame:
    """One row per row of ``df`` (doc_id, text): doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score. No shuffle."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(c).alias("confidence"), F.lit(w).alias("keyword"), F.lit(e).alias("expression")) for k, label, p, c, w, e in rules()])
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = df.select("doc_id", F.regexp_count(text, F.lit(_WORD)).cast("long").alias("n_words"), F.when(F.regexp_like(text, F.lit(_gate())), normalised(text)).alias("norm"))

    base = []
    for phrase, label in BASE.items():
        parts = F.split(F.col("norm"), f"(?<= ){phrase}(?= )", -1)
        here = F.size(parts) - 1
        last = F.col("n_words") - (_blanks(F.element_at(parts, -1)) - 1) - len(phrase.split(" "))
        base.append(F.when(here > 0, F.struct(here.cast("long").alias("n"), (_blanks(F.element_at(parts, 1)) - 1).cast("long").alias("first"), last.alias("last"), F.lit(label).alias("label"))))
    places = F.filter(F.array(*base), lambda b: b.isNotNull())

    hits = F.filter(table, lambda r: F.contains(F.col("norm"), r["keyword"]))
    found = F.flatten(F.transform(hits, lambda r: _spans(F.col("norm"), r)))
    rows = rows.withColumn("places", F.when(F.col("norm").isNotNull(), places)).withColumn("found", F.when(F.col("norm").isNotNull(), found))

    def within(d: Column, e: Column) -> Column:
        longer = (e["b"] - e["a"]) > (d["b"] - d["a"])
        wins = (e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & (longer | (e["k"] < d["k"])))
        return (e["a"] <= d["a"]) & (e["b"] >= d["b"]) & (e["k"] != d["k"]) & wins

    kept = F.filter("found", lambda d: ~F.exists("found", lambda e: within(d, e)))
    own = F.transform("places", lambda b: b["label"])
    rows = rows.select("doc_id", "n_words", "places", own.alias("own"), kept.alias("kept"))
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(c)), ","), F.lit(""))
    return rows.select(
        "doc_id", "n_words",
        F.coalesce(F.aggregate("places", F.lit(0).cast("long"), lambda a, b: a + b["n"]), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("places", lambda b: b["last"])).alias("last_word"),
        joined("own").alias("base_labels"),
        joined(F.concat("own", F.transform("kept", lambda d: d["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.concat(F.transform("kept", lambda d: d["confidence"]), F.transform("own", lambda _: F.lit(0.7)))), F.lit(0.0)).alias("score"),
    )
