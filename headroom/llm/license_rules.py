"""Signature rules for licenses, in order of priority.

A rule is a line: label | kind | keyword | expression. Expressions are written for a text's words in lower case
with one space between them, punctuation left out ("GPL-3.0" is "gpl 3 0"), and match whole words. Whatever an
expression matches contains its keyword. Kinds go from exact tags to loose mentions; KINDS
gives each one's rank and how certain it is.
"""

from __future__ import annotations

from dataclasses import dataclass

#: kind -> certainty; the order is the priority.
KINDS = {"tag": 1.0, "text": 0.95, "link": 0.9, "name": 0.8, "mention": 0.5}

TABLE = r"""
mit | tag | spdx license identifier mit | spdx license identifier mit
mit-0 | tag | spdx license identifier mit 0 | spdx license identifier mit 0
apache-2.0 | tag | spdx license identifier apache | spdx license identifier apache 2 0
apache-1.1 | tag | spdx license identifier apache | spdx license identifier apache 1 1
bsd-2-clause | tag | spdx license identifier bsd | spdx license identifier bsd 2 clause(?: patent)?
bsd-3-clause | tag | spdx license identifier bsd | spdx license identifier bsd 3 clause(?: clear)?
bsd-4-clause | tag | spdx license identifier bsd | spdx license identifier bsd 4 clause
0bsd | tag | spdx license identifier 0bsd | spdx license identifier 0bsd
isc | tag | spdx license identifier isc | spdx license identifier isc
gpl-2.0-only | tag | spdx license identifier gpl | spdx license identifier gpl 2 0(?: only)?
gpl-2.0-or-later | tag | spdx license identifier gpl | spdx license identifier gpl 2 0 or later
gpl-3.0-only | tag | spdx license identifier gpl | spdx license identifier gpl 3 0(?: only)?
gpl-3.0-or-later | tag | spdx license identifier gpl | spdx license identifier gpl 3 0 or later
lgpl-2.1-only | tag | spdx license identifier lgpl | spdx license identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | tag | spdx license identifier lgpl | spdx license identifier lgpl 2 1 or later
lgpl-3.0-only | tag | spdx license identifier lgpl | spdx license identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | tag | spdx license identifier lgpl | spdx license identifier lgpl 3 0 or later
agpl-3.0-only | tag | spdx license identifier agpl | spdx license identifier agpl 3 0(?: only)?
agpl-3.0-or-later | tag | spdx license identifier agpl | spdx license identifier agpl 3 0 or later
mpl-1.1 | tag | spdx license identifier mpl | spdx license identifier mpl 1 1
mpl-2.0 | tag | spdx license identifier mpl | spdx license identifier mpl 2 0
epl-1.0 | tag | spdx license identifier epl | spdx license identifier epl 1 0
epl-2.0 | tag | spdx license identifier epl | spdx license identifier epl 2 0
cddl-1.0 | tag | spdx license identifier cddl | spdx license identifier cddl 1 [01]
cc0-1.0 | tag | spdx license identifier cc0 | spdx license identifier cc0 1 0
cc-by-3.0 | tag | spdx license identifier cc by | spdx license identifier cc by 3 0
cc-by-4.0 | tag | spdx license identifier cc by | spdx license identifier cc by 4 0
cc-by-sa-3.0 | tag | spdx license identifier cc by sa | spdx license identifier cc by sa 3 0
cc-by-sa-4.0 | tag | spdx license identifier cc by sa | spdx license identifier cc by sa 4 0
cc-by-nc-4.0 | tag | spdx license identifier cc by nc | spdx license identifier cc by nc 4 0
cc-by-nd-4.0 | tag | spdx license identifier cc by nd | spdx license identifier cc by nd 4 0
cc-by-nc-sa-4.0 | tag | spdx license identifier cc by nc sa | spdx license identifier cc by nc sa 4 0
cc-by-nc-nd-4.0 | tag | spdx license identifier cc by nc nd | spdx license identifier cc by nc nd 4 0
unlicense | tag | spdx license identifier unlicense | spdx license identifier unlicense
wtfpl | tag | spdx license identifier wtfpl | spdx license identifier wtfpl
zlib | tag | spdx license identifier zlib | spdx license identifier zlib
bsl-1.0 | tag | spdx license identifier bsl | spdx license identifier bsl 1 0
busl-1.1 | tag | spdx license identifier busl | spdx license identifier busl 1 1
sspl-1.0 | tag | spdx license identifier sspl | spdx license identifier sspl 1 0
artistic-2.0 | tag | spdx license identifier artistic | spdx license identifier artistic 2 0
python-2.0 | tag | spdx license identifier p | spdx license identifier (?:python|psf) 2 0
postgresql | tag | spdx license identifier postgresql | spdx license identifier postgresql
ofl-1.1 | tag | spdx license identifier ofl | spdx license identifier ofl 1 1
eupl-1.2 | tag | spdx license identifier eupl | spdx license identifier eupl 1 2
ms-pl | tag | spdx license identifier ms pl | spdx license identifier ms pl
odbl-1.0 | tag | spdx license identifier odbl | spdx license identifier odbl 1 0
mit | text | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | the above copyright notice and this permission notice | the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software
mit | text | the software is provided as is without warranty of any kind | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
isc | text | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | text | permission to use copy modify and | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?= the software)
postgresql | text | without a written agreement is hereby granted | permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
hpnd | text | permission to use copy modify | permission to use copy modify(?: and)? distribute(?: and sell)? this software and its documentation for any purpose (?:and without fee )?is hereby granted(?: without fee)?
bsd-3-clause | text | endorse or promote products | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-2-clause | text | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-4-clause | text | all advertising materials mentioning features | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | text | redistributions of source code must retain | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | text | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
apache-2.0 | text | licensed under the apache license version 2 0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | text | you may not use this file except in compliance | you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0 | text | grant of copyright license subject to the terms | grant of copyright license subject to the terms and conditions of this license each contributor hereby grants to you
apache-1.1 | text | this product includes software developed by the apache | this product includes software developed by the apache (?:software foundation|group)
gpl-2.0-or-later | text | as published by the free software foundation either version 2 | gnu general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version
gpl-3.0-or-later | text | as published by the free software foundation either version 3 | gnu general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
gpl-2.0-only | text | as published by the free software foundation version 2 | gnu general public license as published by the free software foundation version 2(?: of the license)?(?! or)
gpl-2.0-only | text | the terms of the gnu general public license version 2 | the terms of the gnu general public license version 2(?: only)? as published by the free software foundation
gpl-3.0-only | text | as published by the free software foundation version 3 | gnu general public license as published by the free software foundation version 3(?: of the license)?(?! or)
gpl | text | along with this program if not | you should have received a copy of the gnu general public license along with this program if not
gpl | text | this program is distributed in the hope that it will be useful | this program is distributed in the hope that it will be useful but without any warranty
lgpl-2.1-or-later | text | gnu lesser general public license as published | gnu lesser general public license as published by the free software foundation either version 2 1 (?:of the license )?or at your option any later version
lgpl-3.0-or-later | text | gnu lesser general public license as published | gnu lesser general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
lgpl-2.0-or-later | text | gnu library general public license as published | gnu library general public license as published by the free software foundation either version 2 (?:of the license )?or at your option any later version
agpl-3.0-or-later | text | gnu affero general public license as published | gnu affero general public license as published by the free software foundation either version 3 (?:of the license )?or at your option any later version
agpl-3.0-only | text | use with the gnu affero general public license | (?:remote network interaction )?use with the gnu affero general public license
gfdl-1.3 | text | gnu free documentation license version 1 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 [0-9]
mpl-2.0 | text | this source code form is subject to the terms of the mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 | text | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | text | the contents of this file are subject to the mozilla | the contents of this file are subject to the mozilla public license version 1 0
epl-2.0 | text | eclipse public license | (?:this program and the accompanying materials are made available|made available) under the terms of the eclipse public license (?:v|version )?2 0
epl-1.0 | text | eclipse public license | (?:this program and the accompanying materials are made available|made available) under the terms of the eclipse public license v1 0
cddl-1.0 | text | common development and distribution license | the contents of this file are subject to the terms of the common development and distribution license
unlicense | text | this is free and unencumbered software | this is free and unencumbered software released into the public domain
wtfpl | text | you just do what the fuck you want to | you just do what the fuck you want to
zlib | text | in no event will the authors be held liable for any damages | in no event will the authors be held liable for any damages arising from the use of this software
zlib | text | altered source versions must be plainly marked | altered source versions must be plainly marked as such and must not be misrepresented
bsl-1.0 | text | permission is hereby granted free of charge to any person or organization | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
cc0-1.0 | text | waived all copyright and related or neighboring rights | waived all copyright and related or neighboring rights to
cc0-1.0 | text | to the extent possible under law | to the extent possible under law the (?:author|person)s?
ofl-1.1 | text | this font software is licensed under the sil | this font software is licensed under the sil open font license version 1 1
artistic-2.0 | text | this package is free software you can redistribute it | this package is free software you can redistribute it and or modify it under the terms of the artistic license 2 0
perl | text | under the same terms as perl | (?:you can )?redistribute it and or modify it under the same terms as perl(?: itself)?
python-2.0 | text | this license agreement is between the python software foundation | this license agreement is between the python software foundation psf and the individual or organization
openssl | text | this product includes software developed by the openssl project | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | text | this product includes cryptographic software written by eric young | this product includes cryptographic software written by eric young
sspl-1.0 | text | server side public license | terms of the server side public license version 1
busl-1.1 | text | business source license | use of this software is governed by the business source license
elastic-2.0 | text | elastic license | under (?:one or more )?(?:the )?elastic license 2 0
json | text | the software shall be used for good not evil | the software shall be used for good not evil
beerware | text | if we meet some day and you think this stuff is worth it | if we meet some day and you think this stuff is worth it you can buy me a beer
curl | text | the name of a copyright holder shall not be used | except as contained in this notice the name of a copyright holder shall not be used in advertising
x11 | text | the name of the x consortium shall not be used | except as contained in this notice the name of the x consortium shall not be used in advertising
icu | text | permission to use copy modify merge publish | provided that the above copyright notices? and this permission notice appear in all copies of the software and that both the above copyright notices? and this permission notice appear in supporting documentation(?= permission to use copy modify merge publish)
odbl-1.0 | text | open database license | made available under the open database license
pddl-1.0 | text | public domain dedication and license | made available under the public domain dedication and license
proprietary | text | confidential and proprietary | (?:this (?:file|document|software) (?:is|contains) )?confidential and proprietary(?: information)?
proprietary | text | may be reproduced | no part of this (?:publication|document|book|work) may be reproduced(?: distributed or transmitted)?
proprietary | text | is strictly prohibited | unauthori[sz]ed (?:copying|reproduction|use|distribution)(?: or (?:copying|reproduction|use|distribution))?(?: of this (?:file|document|software|material))?(?: via any medium)? is strictly prohibited
public-domain | text | public domain | (?:this (?:work|file|software|code) (?:is|has been)|released|placed|dedicated) (?:hereby )?(?:released |placed )?(?:in|into|to) the public domain
apache-2.0 | link | apache org licenses license 2 0 | (?:https? )?(?:www )?apache org licenses license 2 0(?: txt| html)?
apache-1.1 | link | apache org licenses license 1 1 | (?:https? )?(?:www )?apache org licenses license 1 1
mit | link | opensource org licenses mit | (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
bsd-2-clause | link | opensource org licenses bsd 2 clause | (?:https? )?(?:www )?opensource org licenses bsd 2 clause
bsd-3-clause | link | opensource org licenses bsd 3 clause | (?:https? )?(?:www )?opensource org licenses bsd 3 clause
bsd | link | opensource org licenses bsd license | (?:https? )?(?:www )?opensource org licenses bsd license(?: php)?
isc | link | opensource org licenses isc | (?:https? )?(?:www )?opensource org licenses isc(?: license)?(?: txt)?
artistic-2.0 | link | opensource org licenses artistic license 2 0 | (?:https? )?(?:www )?opensource org licenses artistic license 2 0
gpl-2.0 | link | gnu org licenses | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3.0 | link | gnu org licenses gpl 3 0 | (?:https? )?(?:www )?gnu org licenses gpl 3 0(?: html| txt)?
gpl | link | gnu org licenses gpl | (?:https? )?(?:www )?gnu org licenses gpl(?: html| txt)?
lgpl-2.1 | link | gnu org licenses | (?:https? )?(?:www )?gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3.0 | link | gnu org licenses lgpl 3 0 | (?:https? )?(?:www )?gnu org licenses lgpl 3 0(?: html| txt)?
agpl-3.0 | link | gnu org licenses agpl | (?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?
gfdl | link | gnu org licenses fdl | (?:https? )?(?:www )?gnu org licenses fdl(?: 1 [23])?(?: html| txt)?
gnu | link | gnu org licenses | (?:https? )?(?:www )?gnu org licenses
mpl-2.0 | link | mozilla org mpl | (?:https? )?(?:www )?mozilla org mpl 2 0
mpl-1.1 | link | mozilla org mpl | (?:https? )?(?:www )?mozilla org mpl mpl 1 1(?: html)?
epl-1.0 | link | eclipse org legal epl v10 | (?:https? )?(?:www )?eclipse org legal epl v10(?: html)?
epl-2.0 | link | eclipse org legal epl 2 0 | (?:https? )?(?:www )?eclipse org legal epl 2 0
bsl-1.0 | link | boost org license 1 0 | (?:https? )?(?:www )?boost org license 1 0(?: txt)?
cc0-1.0 | link | creativecommons org publicdomain zero | (?:https? )?(?:www )?creativecommons org publicdomain zero 1 0
public-domain | link | creativecommons org publicdomain mark | (?:https? )?(?:www )?creativecommons org publicdomain mark 1 0
cc-by-nc-nd-4.0 | link | creativecommons org licenses by nc nd | (?:https? )?(?:www )?creativecommons org licenses by nc nd 4 0
cc-by-nc-nd | link | creativecommons org licenses by nc nd | (?:https? )?(?:www )?creativecommons org licenses by nc nd(?: [0-9] [0-9])?
cc-by-nc-sa-4.0 | link | creativecommons org licenses by nc sa | (?:https? )?(?:www )?creativecommons org licenses by nc sa 4 0
cc-by-nc-sa | link | creativecommons org licenses by nc sa | (?:https? )?(?:www )?creativecommons org licenses by nc sa(?: [0-9] [0-9])?
cc-by-nc-4.0 | link | creativecommons org licenses by nc | (?:https? )?(?:www )?creativecommons org licenses by nc 4 0
cc-by-nc | link | creativecommons org licenses by nc | (?:https? )?(?:www )?creativecommons org licenses by nc(?: [0-9] [0-9])?
cc-by-nd-4.0 | link | creativecommons org licenses by nd | (?:https? )?(?:www )?creativecommons org licenses by nd 4 0
cc-by-nd | link | creativecommons org licenses by nd | (?:https? )?(?:www )?creativecommons org licenses by nd(?: [0-9] [0-9])?
cc-by-sa-4.0 | link | creativecommons org licenses by sa | (?:https? )?(?:www )?creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | link | creativecommons org licenses by sa | (?:https? )?(?:www )?creativecommons org licenses by sa 3 0
cc-by-sa | link | creativecommons org licenses by sa | (?:https? )?(?:www )?creativecommons org licenses by sa(?: [0-9] [0-9])?
cc-by-4.0 | link | creativecommons org licenses by 4 0 | (?:https? )?(?:www )?creativecommons org licenses by 4 0
cc-by-3.0 | link | creativecommons org licenses by 3 0 | (?:https? )?(?:www )?creativecommons org licenses by 3 0
cc-by | link | creativecommons org licenses by | (?:https? )?(?:www )?creativecommons org licenses by(?: [0-9] [0-9])?
ofl-1.1 | link | scripts sil org ofl | (?:https? )?scripts sil org ofl
unlicense | link | unlicense org | (?:https? )?unlicense org
wtfpl | link | wtfpl net | (?:https? )?(?:www )?wtfpl net
odbl-1.0 | link | opendatacommons org licenses odbl | (?:https? )?(?:www )?opendatacommons org licenses odbl(?: 1 0)?
odc-by-1.0 | link | opendatacommons org licenses by | (?:https? )?(?:www )?opendatacommons org licenses by(?: 1 0)?
pddl-1.0 | link | opendatacommons org licenses pddl | (?:https? )?(?:www )?opendatacommons org licenses pddl(?: 1 0)?
eupl | link | joinup ec europa eu | (?:https? )?joinup ec europa eu (?:software page|collection eupl) eupl(?: [a-z0-9]+)?
apache-2.0 | name | apache | (?:the )?apache(?: software)?(?: foundation)?(?: public)? licen[cs]e (?:version )?(?:v ?)?2(?: 0)?
apache-2.0 | name | apache | (?:the )?apache (?:v ?)?2(?: 0)?(?: licen[cs]ed?)?
apache-1.1 | name | apache | (?:the )?apache(?: software)? licen[cs]e (?:version )?(?:v ?)?1 1
apache-1.0 | name | apache | (?:the )?apache(?: software)? licen[cs]e (?:version )?(?:v ?)?1 0
apache | name | apache | (?:the )?apache(?: software)?(?: public)? licen[cs]e
mit-0 | name | mit no attribution | (?:the )?mit no attribution(?: licen[cs]e)?
mit-0 | name | mit 0 licen | (?:the )?mit 0 licen[cs]e
mit | name | licen | (?:the |an )?mit(?: x11| expat| style)? licen[cs]ed?
mit | name | licen | (?:the )?expat(?: mit)? licen[cs]e
x11 | name | x11 | (?:the )?x11 licen[cs]e
bsd-2-clause | name | bsd | (?:the )?(?:simplified |freebsd )?bsd (?:2|two) clause(?: licen[cs]e)?
bsd-2-clause | name | bsd | (?:the )?(?:2|two) clause bsd(?: style)?(?: licen[cs]e)?
bsd-2-clause | name | bsd licen | (?:the )?simplified bsd licen[cs]e
bsd-3-clause | name | bsd | (?:the )?(?:new |modified |revised )?bsd (?:3|three) clause(?: licen[cs]e)?
bsd-3-clause | name | bsd | (?:the )?(?:3|three) clause bsd(?: style)?(?: licen[cs]e)?
bsd-3-clause | name | bsd licen | (?:the )?(?:new|modified|revised) bsd licen[cs]e
bsd-4-clause | name | bsd | (?:the )?(?:original |old )?bsd (?:4|four) clause(?: licen[cs]e)?
bsd-4-clause | name | bsd licen | (?:the )?(?:original|old) bsd licen[cs]e
0bsd | name | bsd | (?:the )?(?:zero clause bsd|0bsd)(?: licen[cs]e)?
bsd | name | bsd | (?:the |a )?bsd(?: style| like| type)? licen[cs]ed?
isc | name | isc licen | (?:the )?isc licen[cs]e
gpl-1.0 | name | general public licen | (?:the )?(?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v ?)1(?: 0)?
gpl-2.0-or-later | name | general public licen | (?:the )?(?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v ?)?2(?: 0)? (?:or|and) (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?
gpl-2.0 | name | general public licen | (?:the )?(?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v ?)?2(?: 0)?
gpl-3.0-or-later | name | general public licen | (?:the )?(?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v ?)?3(?: 0)? (?:or|and) (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?
gpl-3.0 | name | general public licen | (?:the )?(?:gnu )?general public licen[cs]e (?:gpl )?(?:version |v ?)?3(?: 0)?
gpl | name | general public licen | (?:the )?(?:gnu )?general public licen[cs]e
gpl-2.0-or-later | name | gpl | (?:the )?(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)? (?:or|and) (?:any )?(?:later|newer)(?: versions?)?
gpl-2.0-only | name | gpl | (?:the )?(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)? only
gpl-2.0 | name | gpl | (?:the )?(?:gnu )?gpl ?(?:version |v ?)?2(?: 0)?(?: licen[cs]ed?)?
gpl-3.0-or-later | name | gpl | (?:the )?(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)? (?:or|and) (?:any )?(?:later|newer)(?: versions?)?
gpl-3.0-only | name | gpl | (?:the )?(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)? only
gpl-3.0 | name | gpl | (?:the )?(?:gnu )?gpl ?(?:version |v ?)?3(?: 0)?(?: licen[cs]ed?)?
gpl | name | gpl | (?:the )?(?:gnu gpl|gpl licen[cs]ed?|gpl compatible)
lgpl-2.1 | name | general public licen | (?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e (?:lgpl )?(?:version |v ?)?2 1(?: or (?:any )?later(?: version)?)?
lgpl-2.0 | name | general public licen | (?:the )?(?:gnu )?library general public licen[cs]e (?:version |v ?)?2(?: 0)?
lgpl-3.0 | name | general public licen | (?:the )?(?:gnu )?lesser general public licen[cs]e (?:lgpl )?(?:version |v ?)?3(?: 0)?(?: or (?:any )?later(?: version)?)?
lgpl | name | general public licen | (?:the )?(?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl-2.1 | name | lgpl | (?:the )?(?:gnu )?lgpl ?(?:version |v ?)?2 1(?: or later| only)?
lgpl-3.0 | name | lgpl | (?:the )?(?:gnu )?lgpl ?(?:version |v ?)?3(?: 0)?(?: or later| only)?
lgpl | name | lgpl | (?:the )?(?:gnu )?lgpl(?: licen[cs]ed?)?
agpl-3.0 | name | affero | (?:the )?(?:gnu )?affero(?: general)? public licen[cs]e (?:agpl )?(?:version |v ?)?3(?: 0)?(?: or (?:any )?later(?: version)?)?
agpl | name | affero | (?:the )?(?:gnu )?affero(?: general)? public licen[cs]e
agpl-3.0 | name | agpl | (?:the )?(?:gnu )?agpl ?(?:version |v ?)?3(?: 0)?(?: or later| only)?
agpl | name | agpl | (?:the )?(?:gnu )?agpl(?: licen[cs]ed?)?
gfdl | name | free documentation licen | (?:the )?(?:gnu )?free documentation licen[cs]e(?: (?:version |v ?)?1 [0-9])?
gcc-exception | name | runtime library exception | (?:the )?gcc runtime library exception(?: version 3 1)?
classpath-exception | name | classpath exception | (?:the )?(?:gnu )?classpath exception
mpl-2.0 | name | mozilla public licen | (?:the )?mozilla public licen[cs]e (?:mpl )?(?:version |v ?)?2(?: 0)?
mpl-1.1 | name | mozilla public licen | (?:the )?mozilla public licen[cs]e (?:mpl )?(?:version |v ?)?1 1
mpl | name | mozilla public licen | (?:the )?mozilla public licen[cs]e
mpl-2.0 | name | mpl | (?:the )?mpl ?(?:version |v ?)?2 0
epl-2.0 | name | eclipse public licen | (?:the )?eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
epl-1.0 | name | eclipse public licen | (?:the )?eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
epl | name | eclipse public licen | (?:the )?eclipse public licen[cs]e
edl-1.0 | name | eclipse distribution licen | (?:the )?eclipse distribution licen[cs]e(?: (?:version |v ?)?1 0)?
cddl-1.0 | name | common development and distribution licen | (?:the )?common development and distribution licen[cs]e(?: (?:version |v ?)?1 [01])?
cpl-1.0 | name | common public licen | (?:the )?common public licen[cs]e(?: (?:version |v ?)?1 0)?
ipl-1.0 | name | ibm public licen | (?:the )?ibm public licen[cs]e(?: (?:version |v ?)?1 0)?
cc0-1.0 | name | cc0 | (?:the )?(?:creative commons )?(?:cc )?cc0(?: 1 0)?(?: universal)?(?: public domain dedication| licen[cs]e)?
cc0-1.0 | name | creative commons zero | (?:the )?creative commons zero(?: v?1 0)?(?: universal)?
cc-by-nc-nd | name | noncommercial noderiv | (?:creative commons )?attribution noncommercial noderiv(?:ative)?s?(?: [0-9] [0-9])?(?: international| unported| generic)?
cc-by-nc-nd | name | non commercial no deriv | (?:creative commons )?attribution non commercial no deriv(?:ative)?s?(?: works)?(?: [0-9] [0-9])?(?: international| unported| generic)?
cc-by-nc-sa | name | noncommercial sharealike | (?:creative commons )?attribution noncommercial sharealike(?: [0-9] [0-9])?(?: international| unported| generic)?
cc-by-nc-sa | name | non commercial share alike | (?:creative commons )?attribution non commercial share alike(?: [0-9] [0-9])?(?: international| unported| generic)?
cc-by-nc | name | attribution noncommercial | (?:creative commons )?attribution noncommercial(?: [0-9] [0-9])?(?: international| unported| generic)?
cc-by-nc | name | attribution non commercial | (?:creative commons )?attribution non commercial(?: [0-9] [0-9])?(?: international| unported| generic)?
cc-by-nd | name | attribution no | (?:creative commons )?attribution (?:noderivatives|noderivs|no derivatives|no derivs)(?: [0-9] [0-9])?(?: international| unported| generic)?
cc-by-sa | name | attribution share | (?:creative commons )?attribution share ?alike(?: [0-9] [0-9])?(?: international| unported| generic)?
cc-by | name | creative commons attribution | creative commons attribution(?: licen[cs]e)?(?: [0-9] [0-9])?(?: international| unported| generic)?(?: licen[cs]e)?
cc-by-nc-nd | name | cc by nc nd | cc by nc nd(?: [0-9] [0-9])?
cc-by-nc-sa | name | cc by nc sa | cc by nc sa(?: [0-9] [0-9])?
cc-by-nc | name | cc by nc | cc by nc(?: [0-9] [0-9])?
cc-by-nd | name | cc by nd | cc by nd(?: [0-9] [0-9])?
cc-by-sa | name | cc by sa | cc by sa(?: [0-9] [0-9])?
cc-by-4.0 | name | cc by 4 0 | cc by 4 0
cc-by-3.0 | name | cc by 3 0 | cc by 3 0
unlicense | name | unlicense | the unlicense
wtfpl | name | what the f | do what the f[a-z]* you want to public licen[cs]e
zlib | name | zlib | (?:the )?zlib(?: libpng)? licen[cs]e
libpng | name | libpng licen | (?:the )?libpng licen[cs]e(?: (?:version |v ?)?2)?
bsl-1.0 | name | boost software licen | (?:the )?boost software licen[cs]e(?: (?:version |v ?)?1 0)?
busl-1.1 | name | business source licen | (?:the )?business source licen[cs]e(?: (?:version |v ?)?1 [01])?
sspl-1.0 | name | server side public licen | (?:the )?server side public licen[cs]e(?: (?:version |v ?)?1)?
elastic-2.0 | name | elastic licen | (?:the )?elastic licen[cs]e (?:version |v ?)?2(?: 0)?
commons-clause | name | commons clause | (?:the )?commons clause(?: licen[cs]e)?(?: condition)?(?: v1 0)?
polyform | name | polyform | (?:the )?polyform (?:noncommercial|small business|free trial|shield|strict|internal use|perimeter)(?: licen[cs]e)?(?: 1 0 0)?
blueoak-1.0.0 | name | blue oak model licen | (?:the )?blue oak model licen[cs]e(?: 1 0 0)?
artistic-2.0 | name | artistic licen | (?:the )?artistic licen[cs]e (?:version |v ?)?2(?: 0)?
artistic-1.0 | name | artistic licen | (?:the )?(?:original )?artistic licen[cs]e(?: (?:version |v ?)?1 0)?
python-2.0 | name | licen | (?:the )?python(?: software foundation)? licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
psf-2.0 | name | psf licen | (?:the )?psf licen[cs]e(?: agreement)?
php-3.01 | name | php licen | (?:the )?php licen[cs]e(?: (?:version |v ?)?3(?: 0)?1?)?
ruby | name | licen | (?:the )?ruby(?: s)? licen[cs]e
vim | name | vim licen | (?:the )?vim licen[cs]e
tcl | name | licen | (?:the )?tcl(?: tk)? licen[cs]e
ncsa | name | university of illinois | (?:the )?university of illinois(?: ncsa)? open source licen[cs]e
postgresql | name | postgresql licen | (?:the )?postgresql licen[cs]e
openssl | name | licen | (?:the )?openssl(?: ssleay)? licen[cs]e
ofl-1.1 | name | open font licen | (?:the )?(?:sil )?open font licen[cs]e(?: (?:version |v ?)?1 1)?
eupl-1.2 | name | european union public licen | (?:the )?european union public licen[cs]e (?:eupl )?(?:version |v ?)?1 2
eupl | name | european union public licen | (?:the )?european union public licen[cs]e
cecill | name | cecill | (?:the )?cecill(?: [bc])?(?: free software)?(?: licen[cs]e)?(?: agreement)?
upl-1.0 | name | universal permissive licen | (?:the )?universal permissive licen[cs]e(?: (?:version |v ?)?1 0)?
ms-pl | name | microsoft public licen | (?:the )?microsoft public licen[cs]e(?: ms pl)?
ms-rl | name | microsoft reciprocal licen | (?:the )?microsoft reciprocal licen[cs]e(?: ms rl)?
apsl-2.0 | name | apple public source licen | (?:the )?apple public source licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
osl-3.0 | name | open software licen | (?:the )?open software licen[cs]e(?: (?:version |v ?)?[123](?: [01])?)?
afl-3.0 | name | academic free licen | (?:the )?academic free licen[cs]e(?: (?:version |v ?)?[123](?: [01])?)?
ecl-2.0 | name | educational community licen | (?:the )?educational community licen[cs]e(?: (?:version |v ?)?[12] 0)?
lppl | name | latex project public licen | (?:the )?latex project public licen[cs]e(?: (?:version |v ?)?1 [0-3][abc]?)?
mulan-psl-2.0 | name | mulan | (?:the )?mulan(?: permissive software)? (?:licen[cs]e|psl)(?: (?:version |v ?)?2)?
open-rail | name | licen | (?:the )?(?:creativeml |bigscience )?(?:open ?rail|responsible ai)(?: m)? licen[cs]e
llama | name | community licen | (?:the )?llama (?:[0-9] )*community licen[cs]e(?: agreement)?
odbl-1.0 | name | open database licen | (?:the )?open database licen[cs]e(?: (?:version |v ?)?1 0)?
odc-by-1.0 | name | open data commons attribution | (?:the )?open data commons attribution licen[cs]e
ogl-uk-3.0 | name | open government licen | (?:the )?open government licen[cs]e(?: (?:version |v ?)?[123](?: 0)?)?
cdla | name | community data licen | (?:the )?community data licen[cs]e agreement(?: (?:permissive|sharing))?
creative-commons | mention | creative commons | (?:a |the |under )?creative commons(?: licen[cs]e[ds]?)?
free-license | mention | licen | licensed under (?:the|a) terms of
free-license | mention | licen | (?:released|licensed|distributed|published|made available) under (?:the|a|an) [^ ]+(?: [^ ]+)? licen[cs]e
open-source | mention | open source licen | (?:an? )?open source licen[cs]e[ds]?
see-license | mention | licen | see the (?:file )?licen[cs]e(?: txt| md)?(?: file)? for (?:more )?(?:details|information|terms)
see-license | mention | copying | see the (?:file )?copying(?: txt)?(?: file)? for (?:more )?(?:details|information|terms|the (?:full )?licen[cs]e)
public-domain | mention | public domain | (?:the )?public domain
rights-statement | mention | rights reserved | (?:all|some|no) rights reserved
copyright | mention | copyright | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*
freeware | mention | freeware | freeware
commercial | mention | commercial licen | (?:a |the )?commercial licen[cs]e
commercial | mention | commercial use | (?:not )?for (?:non )?commercial use(?: only)?
permission | mention | permission | (?:used|reprinted|reproduced) with(?: the)?(?: kind| express| written| prior)* permission
""".strip().splitlines()


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    keyword: str
    pattern: str


RULES = tuple(Rule(*line.split(" | ", 3)) for line in TABLE)
