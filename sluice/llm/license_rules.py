"""Hand-written licence signatures.

A family is a line ``label | keywords | priority | regex of its name | version regex or -``. Texts are matched as lower-case
words with single spaces, so punctuation has no place in the patterns. From each family three rules are made: its name,
its name with a version, and its name as the object of a licence statement. Every match of a rule has one of its keywords
as a word. Identifiers of SPDX tags are patterns of their own.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    keyword: str      # a rule is tried only where this word occurs
    priority: int     # the greater one suppresses what lies inside it
    weight: float     # how sure a match is, 0 to 1
    pattern: re.Pattern


#: The base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Name patterns, hand-written; "-" means that the family has no versions.
FAMILIES = """
mit | mit | 5 | (?:the )?mit(?: expat)? licen[cs]e | -
mit-0 | mit | 7 | mit (?:0|no attribution)(?: licen[cs]e)? | -
mit-x11 | x11 | 6 | (?:mit )?x11 licen[cs]e | -
mit-modern | modern | 6 | mit licen[cs]e modern variant | -
apache | apache | 5 | apache(?: software)? licen[cs]e | [12](?: [01])?
apache | apache | 4 | apache 2(?: 0)? | -
gpl | gpl,gpl1,gpl2,gpl3,gplv1,gplv2,gplv3 | 4 | (?:gnu )?gpl(?:v?[123])? | [123](?: 0)?
gpl | gnu | 5 | gnu general public licen[cs]e | [123](?: 0)?
gpl | gplv2 | 4 | gplv2(?: only| or later)? | -
gpl | gplv3 | 4 | gplv3(?: only| or later)? | -
lgpl | lgpl,lgpl2,lgpl3,lgplv2,lgplv3 | 6 | (?:gnu )?lgpl(?:v?[23])? | [23](?: [01])?
lgpl | lesser | 7 | (?:gnu )?lesser general public licen[cs]e | [23](?: [01])?
lgpl | library | 7 | (?:gnu )?library general public licen[cs]e | 2(?: 0)?
agpl | agpl,agpl3,agplv3 | 6 | (?:gnu )?agpl(?:v?3)? | [13](?: 0)?
agpl | affero | 7 | (?:gnu )?affero general public licen[cs]e | [13](?: 0)?
gfdl | documentation | 6 | (?:gnu )?free documentation licen[cs]e | 1(?: [123])?
gfdl | gfdl | 5 | gfdl | 1(?: [123])?
bsd | bsd | 4 | (?:the )?bsd(?: style| type)? licen[cs]e | -
bsd-2-clause | bsd,freebsd | 6 | (?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: licen[cs]e)? | -
bsd-3-clause | bsd | 6 | (?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: licen[cs]e)? | -
bsd-4-clause | bsd | 6 | (?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: licen[cs]e)? | -
bsd-0-clause | bsd,0bsd | 6 | (?:0bsd|zero clause bsd|bsd 0 clause|bsd zero clause)(?: licen[cs]e)? | -
isc | isc | 5 | isc licen[cs]e | -
mpl | mozilla | 5 | mozilla public licen[cs]e | [12](?: [01])?
mpl | mpl | 4 | mpl | [12](?: [01])?
epl | eclipse | 5 | eclipse public licen[cs]e | [12](?: 0)?
edl | eclipse | 5 | eclipse distribution licen[cs]e | 1(?: 0)?
cddl | cddl | 4 | cddl | 1(?: [01])?
cddl | distribution | 5 | common development and distribution licen[cs]e | 1(?: [01])?
cpl | cpl | 4 | cpl | 1(?: 0)?
cpl | common | 5 | common public licen[cs]e | 1(?: 0)?
eupl | eupl | 4 | eupl | 1(?: [012])?
eupl | european | 5 | european union public licen[cs]e | 1(?: [012])?
cecill | cecill | 5 | cecill(?: [abc])?(?: licen[cs]e)? | [12](?: [01])?
artistic | artistic | 5 | (?:the )?(?:perl )?artistic licen[cs]e | [12](?: 0)?
zlib | zlib | 5 | zlib(?: libpng)? licen[cs]e | -
libpng | libpng | 5 | libpng licen[cs]e | 2
boost | boost | 5 | boost software licen[cs]e | 1(?: 0)?
unlicense | unlicense | 4 | (?:the )?unlicense | -
wtfpl | wtfpl | 4 | wtfpl | 2
beerware | beerware | 4 | beerware(?: licen[cs]e)? | 42
python | python | 5 | python(?: software foundation)? licen[cs]e | 2
php | php | 5 | php licen[cs]e | 3(?: 0[01])?
ruby | ruby | 5 | ruby licen[cs]e | -
perl | perl | 4 | (?:same|licensed) terms as perl(?: itself)? | -
openssl | openssl | 5 | openssl(?: ssleay)? licen[cs]e | -
openldap | openldap | 5 | openldap public licen[cs]e | 2(?: [0-8])?
postgresql | postgresql | 5 | postgresql licen[cs]e | -
sqlite | sqlite | 4 | sqlite blessing | -
curl | curl | 5 | curl licen[cs]e | -
ncsa | ncsa | 5 | (?:university of illinois )?ncsa(?: open source)? licen[cs]e | -
w3c | w3c | 5 | w3c(?: software)?(?: notice and)? licen[cs]e | -
icu | icu | 5 | icu licen[cs]e | -
unicode | unicode | 5 | unicode (?:dfs 2015|dfs 2016|inc licen[cs]e agreement|licen[cs]e) | 3
vim | vim | 5 | vim licen[cs]e | -
tcl | tcl | 5 | tcl tk licen[cs]e | -
latex | latex | 5 | latex project public licen[cs]e | 1(?: [0-3])?
lppl | lppl | 4 | lppl | 1(?: [0-3])?
ofl | ofl | 4 | (?:sil )?ofl | 1(?: [01])?
ofl | sil | 5 | sil open font licen[cs]e | 1(?: [01])?
bitstream | bitstream | 5 | bitstream vera(?: font)? licen[cs]e | -
ubuntu-font | ubuntu | 5 | ubuntu font licen[cs]e | 1(?: 0)?
ms-pl | microsoft | 5 | microsoft public licen[cs]e | -
ms-rl | reciprocal | 5 | microsoft reciprocal licen[cs]e | -
apsl | apple | 5 | apple public source licen[cs]e | [12](?: [012])?
npl | netscape | 5 | netscape public licen[cs]e | 1(?: [01])?
spl | sun | 5 | sun public licen[cs]e | 1(?: 0)?
ibm-pl | ibm | 5 | ibm public licen[cs]e | 1(?: 0)?
intel | intel | 5 | intel(?: open source| simplified software)? licen[cs]e | -
nokia | nokia | 5 | nokia open source licen[cs]e | 1(?: 0a)?
qpl | qpl | 4 | qpl | 1(?: 0)?
qpl | q | 5 | q public licen[cs]e | 1(?: 0)?
rpl | rpl | 4 | rpl | 1(?: [15])?
rpl | reciprocal | 5 | reciprocal public licen[cs]e | 1(?: [15])?
osl | osl | 4 | osl | [123](?: 0)?
osl | open | 5 | open software licen[cs]e | [123](?: 0)?
afl | academic | 5 | academic free licen[cs]e | [123](?: 0)?
nasa | nasa | 5 | nasa open source agreement | 1(?: 3)?
nosl | nethack | 5 | nethack general public licen[cs]e | -
ijg | jpeg | 5 | independent jpeg group licen[cs]e | -
info-zip | zip | 5 | info zip licen[cs]e | -
json | json | 5 | json licen[cs]e | -
upl | upl | 4 | upl | 1(?: 0)?
upl | permissive | 5 | universal permissive licen[cs]e | 1(?: 0)?
mulan | mulan | 5 | mulan(?: psl| permissive software licen[cs]e| public licen[cs]e) | [12](?: 0)?
odbl | odbl | 4 | odbl | 1(?: 0)?
odbl | database | 5 | open database licen[cs]e | 1(?: 0)?
odc-by | commons | 5 | open data commons attribution licen[cs]e | 1(?: 0)?
pddl | pddl | 5 | pddl | 1(?: 0)?
etalab | etalab | 5 | etalab(?: open| ouverte)? licen[cs]e | 2(?: 0)?
ogl | government | 5 | open government licen[cs]e | [123](?: 0)?
sspl | side | 5 | server side public licen[cs]e | 1
sspl | sspl | 4 | sspl | 1
busl | business | 5 | business source licen[cs]e | 1(?: 1)?
elastic | elastic | 5 | elastic licen[cs]e | [12](?: 0)?
commons-clause | clause | 5 | commons clause | 1(?: 0)?
confluent | confluent | 5 | confluent community licen[cs]e | 1(?: 0)?
polyform | polyform | 5 | polyform (?:noncommercial|small business|shield|strict|internal use) licen[cs]e | 1(?: 0 0)?
prosperity | prosperity | 5 | prosperity public licen[cs]e | [23](?: 0(?: 0)?)?
parity | parity | 5 | parity public licen[cs]e | [67](?: 0(?: 0)?)?
blue-oak | oak | 5 | blue oak model licen[cs]e | 1(?: 0(?: 0)?)?
hippocratic | hippocratic | 5 | hippocratic licen[cs]e | [123](?: [01])?
openrail | openrail | 5 | (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)? | -
llama | llama | 5 | llama(?: [23])?(?: [0-9])? community licen[cs]e | -
gemma | gemma | 5 | gemma terms of use | -
cc-by | cc | 5 | cc by | [1234](?: [05])?
cc-by-sa | cc | 6 | cc by sa | [1234](?: [05])?
cc-by-nd | cc | 6 | cc by nd | [1234](?: [05])?
cc-by-nc | cc | 6 | cc by nc | [1234](?: [05])?
cc-by-nc-sa | cc | 7 | cc by nc sa | [1234](?: [05])?
cc-by-nc-nd | cc | 7 | cc by nc nd | [1234](?: [05])?
cc0 | cc0 | 5 | cc0(?: public domain)? | 1(?: 0)?
cc0 | zero | 5 | creative commons (?:cc )?zero | 1(?: 0)?
cc-by | creative | 5 | creative commons attribution(?: licen[cs]e)? | [1234](?: [05])?
cc-by-sa | creative | 6 | creative commons attribution share ?alike(?: licen[cs]e)? | [1234](?: [05])?
cc-by-nc | creative | 6 | creative commons attribution non ?commercial(?: licen[cs]e)? | [1234](?: [05])?
cc-by-nd | creative | 6 | creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)? | [1234](?: [05])?
public-domain | domain | 4 | (?:in(?:to)?|dedicated to) the public domain | -
all-rights-reserved | reserved | 4 | all rights reserved | -
proprietary | proprietary | 4 | proprietary and confidential | -
copyright | copyright | 3 | copyright (?:c )?(?:19|20)[0-9]{2} | -
""".strip()

# Clauses of licence texts: label | keyword | regex. Hand-written.
CLAUSES = """
mit | permission | permission is hereby granted free of charge to any person obtaining a copy
bsd-3-clause | endorse | neither the name of (?:[^ ]+ ){1,60}?may be used to endorse or promote products
bsd-2-clause | redistribution | redistribution and use in source and binary forms with or without modification are permitted
apache | compliance | you may not use this file except in compliance with the license
gpl | redistribute | you can redistribute it and or modify it under the terms of the gnu general public license
lgpl | lesser | it under the terms of the gnu lesser general public license
agpl | affero | it under the terms of the gnu affero general public license
isc | granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
zlib | misrepresented | the origin of this software must not be misrepresented
boost | boost | distributed under the boost software license
mpl | mozilla | this source code form is subject to the terms of the mozilla public license
unlicense | unencumbered | this is free and unencumbered software released into the public domain
wtfpl | fuck | do what the fuck you want to public license
cc-by | credit | you must give appropriate credit
cc0 | waived | has waived all copyright and related or neighboring rights
ofl | font | licensed under the sil open font license
""".strip()

# Identifiers behind an SPDX tag, as words: label | regex.
SPDX = """
mit | mit
mit-0 | mit 0
mit-modern | mit modern variant
apache | apache (?:1 [01]|2 0)
gpl | gpl [123] 0(?: only| or later)?
lgpl | lgpl [23] [01](?: only| or later)?
agpl | agpl [13] 0(?: only| or later)?
gfdl | gfdl 1 [123](?: only| or later)?
bsd-0-clause | 0bsd
bsd-2-clause | bsd 2 clause(?: patent| views)?
bsd-3-clause | bsd 3 clause(?: clear| lbnl| attribution)?
bsd-4-clause | bsd 4 clause(?: uc| shortened)?
isc | isc
mpl | mpl [12] [01](?: no copyleft exception)?
epl | epl [12] 0
cddl | cddl 1 [01]
cpl | cpl 1 0
eupl | eupl 1 [012]
cecill | cecill (?:[12] [01]|b|c)
artistic | artistic [12] 0(?: perl| cl8)?
zlib | zlib(?: acknowledgement)?
libpng | libpng(?: 2 0)?
boost | bsl 1 0
busl | busl 1 1
unlicense | unlicense
wtfpl | wtfpl
beerware | beerware
python | (?:python 2 0(?: 1)?|psf 2 0)
php | php 3 0(?:1)?
ruby | ruby
openssl | openssl
openldap | oldap 2 [0-8]
postgresql | postgresql
sqlite | blessing
curl | curl
ncsa | ncsa
w3c | w3c(?: 19980720| 20150513)?
icu | icu
unicode | unicode (?:dfs 2015|dfs 2016|tou|3 0)
vim | vim
tcl | tcl
lppl | lppl 1 (?:0|1|2|3a|3c)
ofl | ofl 1 [01](?: rfn| no rfn)?
bitstream | bitstream vera
ms-pl | ms pl
ms-rl | ms rl
apsl | apsl [12] [012]
npl | npl 1 [01]
spl | spl 1 0
ibm-pl | ipl 1 0
intel | intel
qpl | qpl 1 0
rpl | rpl 1 [15]
osl | osl [123] [01]
afl | afl [123] [012]
nasa | nasa 1 3
ijg | ijg
info-zip | info zip
json | json
upl | upl 1 0
mulan | mulanpsl [12] 0
odbl | odbl 1 0
odc-by | odc by 1 0
pddl | pddl 1 0
etalab | etalab 2 0
sspl | sspl 1 0
elastic | elastic 2 0
blue-oak | blueoak 1 0 0
hippocratic | hippocratic 2 1
cc-by | cc by [1234] [05]
cc-by-sa | cc by sa [1234] [05]
cc-by-nd | cc by nd [1234] [05]
cc-by-nc | cc by nc [1234] [05]
cc-by-nc-sa | cc by nc sa [1234] [05]
cc-by-nc-nd | cc by nc nd [1234] [05]
cc0 | cc0 1 0
public-domain | cc pddc
""".strip()

STATEMENT = r"(?:licensed|released|distributed|available|published|covered|used) (?:under|by)(?: the)?(?: terms of)?(?: the)? "
TAG = r"spdx license identifier "


def rules() -> list[Rule]:
    """All signatures; of equal priority the earlier one goes first."""
    made = []
    for line in FAMILIES.splitlines():
        label, keyword, priority, name, version = (part.strip() for part in line.split("|", 4)) if line.count("|") == 4 \
            else _wide(line)
        forms = [(int(priority), 0.7, name), (int(priority) + 20, 0.95, STATEMENT + name), (int(priority) + 30, 1.0, TAG + name)]
        if version != "-":
            forms.append((int(priority) + 10, 0.85, f"{name}(?: version| v)? {version}"))
        made += [Rule(label, word, p, w, re.compile(f"(?<= )(?:{x})(?= )")) for p, w, x in forms for word in keyword.split(",")]
    for line in CLAUSES.splitlines():
        label, keyword, clause = (part.strip() for part in line.split("|", 2))
        made.append(Rule(label, keyword, 40, 1.0, re.compile(f"(?<= )(?:{clause})(?= )")))
    for line in SPDX.splitlines():
        label, name = (part.strip() for part in line.split("|", 1))
        made.append(Rule(label, "spdx", 50, 1.0, re.compile(f"(?<= )(?:{TAG}{name})(?= )")))
    return made


def _wide(line: str) -> tuple[str, str, str, str, str]:
    """A family line whose regex holds bars itself."""
    label, keyword, priority, rest = line.split(" | ", 3)
    name, version = rest.rsplit(" | ", 1)
    return label.strip(), keyword.strip(), priority, name.strip(), version.strip()
