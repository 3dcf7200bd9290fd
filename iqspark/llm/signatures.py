"""Licence signatures, written by hand: label | priority | keywords | pattern.

Patterns are regular expressions over a text's folded words (0-9, a-z and characters from U+0080) with one space between
them, and match whole words only. A rule is tried where one of its keywords stands in the text. Priorities: 95 statements
made for machines, 90 words of a licence itself, 80 grants, 75 addresses, 70 titles with a version, 60 short names with a
version, 50 notices, 40 titles, 30 and less hints.
"""

from __future__ import annotations

#: Licences that a machine-readable identifier may name, in the form of the identifier.
IDENTIFIERS = "0bsd afl-2.1 afl-3.0 agpl-1.0 agpl-3.0 apache-1.0 apache-1.1 apache-2.0 apsl-2.0 artistic-1.0 artistic-2.0 blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-3-clause bsd-4-clause bsl-1.0 busl-1.1 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 ecl-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 gfdl-1.1 gfdl-1.2 gfdl-1.3 gpl-1.0 gpl-2.0 gpl-3.0 isc lgpl-2.0 lgpl-2.1 lgpl-3.0 lppl-1.3c mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 ms-pl ms-rl mulanpsl-2.0 ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sspl-1.0 unlicense upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()

#: Creative Commons elements with what they are called, and versions.
CC_ELEMENTS = ["by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd"]
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]

SIGNATURES = r"""
apache-2.0 | 90 | apache | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | 90 | patent | each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license
apache-2.0 | 90 | redistribution | you must cause any modified files to carry prominent notices stating that you changed the files
apache-2.0 | 85 | apache | apache license version 2 0 january 2004
apache-2.0 | 80 | apache | (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?
apache-2.0 | 75 | apache | apache org licenses license 2 0
apache-2.0 | 70 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?
apache-2.0 | 60 | apache | apache 2 0
apache-1.1 | 90 | apache | this product includes software developed by the apache software foundation
apache-1.1 | 85 | apache | the apache software license version 1 1
apache-1.1 | 70 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?1 1
apache-1.0 | 90 | apache | this product includes software developed by the apache group for use in the apache http server project
apache-1.0 | 70 | apache | apache(?: software)? licen[cs]e(?: version| v)? ?1 0
apache | 40 | apache | apache(?: software)? licen[cs]e
mit | 90 | permission | permission is hereby granted free of charge to any person obtaining a copy
mit | 90 | sublicense | the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 88 | shall | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 80 | mit expat | (?:licensed|released|distributed|published|available|provided) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11)?(?: licen[cs]e)?
mit | 75 | opensource | opensource org licenses mit
mit | 70 | mit expat | (?:the )?(?:mit|expat) licen[cs]e
mit | 60 | mit | mit (?:x11|style) licen[cs]e
mit-0 | 85 | mit | mit no attribution
x11 | 90 | consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | 70 | x11 | x11 licen[cs]e
bsd-2-clause | 90 | redistribution | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice
bsd-3-clause | 92 | endorse | neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products
bsd-3-clause | 92 | endorse | the names? of (?:the )?(?:[^ ]+ ){1,6}may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause | 94 | advertising | all advertising materials mentioning features or use of this software must display the following acknowledg(?:e)?ment
bsd | 88 | redistribution | redistribution and use in source and binary forms with or without modification are permitted
bsd | 86 | redistributions | redistributions in binary form must reproduce the above copyright notice this list of conditions
bsd | 84 | copyright | this software is provided by the copyright holders? and contributors as is
bsd-3-clause | 80 | bsd | (?:licensed|released|distributed|published|available|provided) under (?:the |a )?(?:3 clause|three clause|new|modified|revised) bsd(?: licen[cs]e)?
bsd-2-clause | 80 | bsd | (?:licensed|released|distributed|published|available|provided) under (?:the |a )?(?:2 clause|two clause|simplified) bsd(?: licen[cs]e)?
bsd | 78 | bsd | (?:licensed|released|distributed|published|available|provided) under (?:the |a )?bsd(?: style)? licen[cs]e
bsd-3-clause | 75 | opensource | opensource org licenses bsd 3 clause
bsd-2-clause | 75 | opensource | opensource org licenses bsd 2 clause
bsd-3-clause | 70 | bsd | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?
bsd-2-clause | 70 | bsd | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)?
bsd-4-clause | 70 | bsd | (?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd|old bsd)(?: licen[cs]e)?
bsd-1-clause | 70 | bsd | (?:bsd 1 clause|1 clause bsd)(?: licen[cs]e)?
0bsd | 70 | bsd | (?:bsd zero clause|zero clause bsd|0 clause bsd|bsd 0 clause)(?: licen[cs]e)?
bsd | 40 | bsd | bsd(?: style| type| like)? licen[cs]e
isc | 90 | permission | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | 89 | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
isc | 85 | isc | the software is provided as is and isc disclaims all warranties
isc | 80 | isc | (?:licensed|released|distributed) under (?:the )?isc(?: licen[cs]e)?
isc | 75 | opensource | opensource org licenses isc
isc | 70 | isc | isc licen[cs]e
gpl-3.0 | 90 | affero | notwithstanding any other provision of this license you have permission to link or combine any covered work with a work licensed under version 3 of the gnu affero general public license
gpl-3.0 | 85 | gnu | gnu general public license version 3 29 june 2007
gpl-3.0-or-later | 85 | gnu | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
gpl-3.0 | 82 | gnu | gnu general public license as published by the free software foundation version 3(?: of the license)?
gpl-3.0-or-later | 80 | gpl general | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3.0-only | 80 | gpl general | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?3(?: 0)? only
gpl-3.0 | 75 | gnu | gnu org licenses gpl 3 0
gpl-3.0 | 70 | general | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?3(?: 0)?
gpl-3.0 | 60 | gpl gplv3 | (?:gnu )?(?:gplv3|gpl(?: licen[cs]e)?(?: version| v)? ?3(?: 0)?)
gpl-2.0 | 85 | gnu | gnu general public license version 2 june 1991
gpl-2.0-or-later | 85 | gnu | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
gpl-2.0 | 82 | gnu | gnu general public license as published by the free software foundation version 2(?: of the license)?
gpl-2.0 | 82 | gnu | under the terms of version 2 of the gnu general public license
gpl-2.0-or-later | 80 | gpl general | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2.0-only | 80 | gpl general | (?:gnu )?(?:gpl|general public licen[cs]e)(?: version| v)? ?2(?: 0)? only
gpl-2.0 | 75 | gnu | gnu org licenses (?:old licenses )?gpl 2 0
gpl-2.0 | 70 | general | (?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v)? ?2(?: 0)?
gpl-2.0 | 60 | gpl gplv2 | (?:gnu )?(?:gplv2|gpl(?: licen[cs]e)?(?: version| v)? ?2(?: 0)?)
gpl-1.0 | 85 | gnu | gnu general public license version 1 february 1989
gpl-1.0 | 70 | general | (?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?
gpl-classpath-exception | 88 | linking | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gpl-gcc-exception | 88 | gcc | gcc runtime library exception
gpl | 86 | foundation | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 84 | gnu | you should have received a copy of the gnu general public license along with this program
gpl | 78 | gpl general | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public licen[cs]e)
gpl | 40 | general | (?:gnu )?general public licen[cs]e
gpl | 35 | gpl | gnu gpl
lgpl-3.0 | 85 | gnu | gnu lesser general public license version 3 29 june 2007
lgpl-3.0-or-later | 86 | lesser | gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2.1-or-later | 86 | lesser | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-2.1 | 85 | lesser | gnu lesser general public license version 2 1 february 1999
lgpl-2.0-or-later | 86 | library | gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
lgpl-2.0 | 85 | library | gnu library general public license version 2 june 1991
lgpl-3.0-or-later | 81 | lgpl lesser | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
lgpl-2.1-or-later | 81 | lgpl lesser | (?:gnu )?(?:lgpl|lesser general public licen[cs]e)(?: version| v)? ?2 1 or (?:at your option )?(?:any )?later(?: version)?
lgpl-3.0 | 76 | gnu | gnu org licenses lgpl 3 0
lgpl-2.1 | 76 | gnu | gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | 71 | lesser lgpl lgplv3 | (?:gnu )?(?:lesser general public licen[cs]e|lgplv3|lgpl)(?: version| v)? ?3?(?<=3)(?: 0)?
lgpl-2.1 | 71 | lesser lgpl | (?:gnu )?(?:lesser general public licen[cs]e|lgpl)(?: version| v)? ?2 1
lgpl-2.0 | 71 | library lgpl | (?:gnu )?(?:library general public licen[cs]e|lgpl)(?: version| v)? ?2(?: 0)?
lgpl | 79 | lgpl lesser | (?:licensed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public licen[cs]e)
lgpl | 42 | lesser library | (?:gnu )?(?:lesser|library) general public licen[cs]e
lgpl | 36 | lgpl | gnu lgpl
agpl-3.0 | 86 | affero | gnu affero general public license version 3 19 november 2007
agpl-3.0-or-later | 87 | affero | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
agpl-3.0 | 88 | remotely | you must prominently offer all users interacting with it remotely through a computer network
agpl-3.0 | 76 | gnu | gnu org licenses agpl(?: 3 0)?
agpl-3.0 | 72 | affero | (?:gnu )?affero general public licen[cs]e(?: agpl)?(?: version| v)? ?3(?: 0)?
agpl-3.0 | 61 | agpl agplv3 | (?:gnu )?(?:agplv3|agpl(?: version| v)? ?3(?: 0)?)
agpl-1.0 | 72 | affero | affero general public licen[cs]e(?: version| v)? ?1(?: 0)?
agpl | 43 | affero | (?:gnu )?affero general public licen[cs]e
gfdl-1.3 | 85 | documentation | gnu free documentation license version 1 3 3 november 2008
gfdl-1.3 | 80 | documentation | gnu free documentation licen[cs]e version 1 3(?: or any later version published by the free software foundation)?
gfdl-1.2 | 80 | documentation | gnu free documentation licen[cs]e version 1 2(?: or any later version published by the free software foundation)?
gfdl-1.1 | 80 | documentation | gnu free documentation licen[cs]e version 1 1(?: or any later version published by the free software foundation)?
gfdl | 84 | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl | 82 | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl | 40 | documentation gfdl | (?:gnu free documentation licen[cs]e|gnu fdl|gfdl)
mpl-2.0 | 90 | mozilla | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 90 | incompatible | this source code form is incompatible with secondary licenses as defined by the mozilla public license
mpl-1.1 | 90 | mozilla | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | 90 | mozilla | the contents of this file are subject to the mozilla public license version 1 0
mpl-2.0 | 75 | mozilla | mozilla org mpl 2 0
mpl-2.0 | 70 | mozilla mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? ?2(?: 0)?
mpl-1.1 | 70 | mozilla mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? ?1 1
mpl-1.0 | 70 | mozilla mpl | (?:mozilla public licen[cs]e|mpl)(?: version| v)? ?1 0
mpl | 40 | mozilla | mozilla public licen[cs]e
epl-2.0 | 90 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 2 0
epl-1.0 | 90 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license(?: v| version)? 1 0
epl-2.0 | 75 | eclipse | eclipse org legal epl 2 0
epl-1.0 | 75 | eclipse | eclipse org legal epl v10
epl-2.0 | 70 | eclipse epl | (?:eclipse public licen[cs]e|epl)(?: version| v)? ?2(?: 0)?
epl-1.0 | 70 | eclipse epl | (?:eclipse public licen[cs]e|epl)(?: version| v)? ?1(?: 0)?
epl | 40 | eclipse | eclipse public licen[cs]e
edl-1.0 | 80 | eclipse | eclipse distribution licen[cs]e(?: version| v)? ?1 0
cddl-1.0 | 90 | cddl | common development and distribution license cddl version 1 0
cddl-1.1 | 90 | cddl | common development and distribution license cddl version 1 1
cddl-1.0 | 70 | distribution cddl | (?:common development and distribution licen[cs]e|cddl)(?: version| v)? ?1 0
cddl-1.1 | 70 | distribution cddl | (?:common development and distribution licen[cs]e|cddl)(?: version| v)? ?1 1
cddl | 40 | distribution | common development and distribution licen[cs]e
cpl-1.0 | 70 | common cpl | (?:common public licen[cs]e|cpl)(?: version| v)? ?1(?: 0)?
cpl-1.0 | 40 | common | common public licen[cs]e
ipl-1.0 | 70 | ibm | ibm public licen[cs]e(?: version| v)? ?1 0
cpal-1.0 | 70 | attribution | common public attribution licen[cs]e(?: version| v)? ?1 0
eupl-1.2 | 80 | eupl european | (?:european union public licen[cs]e|eupl)(?: version| v)? ?1 2
eupl-1.1 | 80 | eupl european | (?:european union public licen[cs]e|eupl)(?: version| v)? ?1 1
eupl | 40 | european | european union public licen[cs]e
cecill-2.1 | 80 | cecill | cecill(?: free software license agreement)?(?: version| v)? ?2 1
cecill-b | 80 | cecill | cecill b(?: licen[cs]e)?
cecill-c | 80 | cecill | cecill c(?: licen[cs]e)?
cecill | 40 | cecill | cecill licen[cs]e
artistic-2.0 | 85 | artistic | the artistic license 2 0 copyright c 2000 2006 the perl foundation
artistic-2.0 | 70 | artistic | artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic-1.0 | 85 | artistic | the intent of this document is to state the conditions under which a package may be copied
artistic-1.0 | 70 | artistic | artistic licen[cs]e(?: version| v)? ?1(?: 0)?
perl | 85 | perl | (?:under|on) the same terms as perl(?: 5)?(?: programming language)?(?: system)? itself
artistic | 40 | artistic | artistic licen[cs]e
afl-3.0 | 75 | academic | academic free licen[cs]e(?: version| v)? ?3(?: 0)?
afl-2.1 | 75 | academic | academic free licen[cs]e(?: version| v)? ?2 1
osl-3.0 | 75 | open | open software licen[cs]e(?: version| v)? ?3(?: 0)?
osl-2.1 | 75 | open | open software licen[cs]e(?: version| v)? ?2 1
bsl-1.0 | 90 | boost | distributed under the boost software license version 1 0
bsl-1.0 | 75 | boost | boost org license 1 0
bsl-1.0 | 70 | boost | boost software licen[cs]e(?: version| v)? ?1(?: 0)?
bsl-1.0 | 40 | boost | boost(?: software)? licen[cs]e
busl-1.1 | 85 | business | business source licen[cs]e(?: version| v)? ?1 1
busl-1.1 | 84 | change | change date (?:[^ ]+ ){1,8}change license
busl-1.1 | 40 | business | business source licen[cs]e
zlib | 90 | warranty | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | 88 | misrepresented | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | 86 | altered | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 70 | zlib | zlib(?: libpng)? licen[cs]e
libpng | 70 | libpng | libpng licen[cs]e
unlicense | 90 | unencumbered | this is free and unencumbered software released into the public domain
unlicense | 75 | unlicense | unlicense org
unlicense | 70 | unlicense unlicence | (?:the )?unlicen[cs]e
wtfpl | 90 | fuck | do what the fuck you want to public license
wtfpl | 70 | wtfpl | wtfpl
python-2.0 | 85 | python | python software foundation license(?: version 2| agreement)?
python-2.0 | 84 | psf | psf is making python available to licensee on an as is basis
python-2.0 | 70 | psf python | (?:psf|python)(?: 2 0)? licen[cs]e
php-3.01 | 85 | php | this source file is subject to version 3 01 of the php license
php-3.0 | 85 | php | this source file is subject to version 3 0 of the php license
php-3.01 | 70 | php | php licen[cs]e(?: version| v)? ?3 01
php | 40 | php | php licen[cs]e
ruby | 80 | ruby | (?:under|on) the same terms as ruby(?: itself)?
ruby | 70 | ruby | ruby licen[cs]e
openssl | 90 | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | 70 | openssl | openssl licen[cs]e
ssleay | 90 | cryptographic | this product includes cryptographic software written by eric young
postgresql | 90 | postgresql | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
postgresql | 70 | postgresql | postgresql licen[cs]e
ncsa | 90 | deal | to deal with the software without restriction including without limitation the rights
ncsa | 70 | illinois ncsa | (?:university of illinois(?: ncsa)?(?: open source)?|ncsa(?: open source)?) licen[cs]e
ms-pl | 75 | microsoft ms | (?:microsoft public licen[cs]e|ms pl)
ms-rl | 75 | microsoft ms | (?:microsoft reciprocal licen[cs]e|ms rl)
ms-eula | 60 | microsoft | microsoft software license terms
ofl-1.1 | 90 | font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | 75 | sil | scripts sil org ofl
ofl-1.1 | 70 | font ofl | (?:sil )?open font licen[cs]e(?: version| v)? ?1 1
ofl-1.0 | 70 | font ofl | (?:sil )?open font licen[cs]e(?: version| v)? ?1 0
ofl | 40 | font | (?:sil )?open font licen[cs]e
odbl-1.0 | 85 | database | made available under the open database license
odbl-1.0 | 75 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
odbl-1.0 | 70 | odbl database | (?:open database licen[cs]e|odbl)(?: version| v)?(?: ?1 0)?
odc-by-1.0 | 75 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
odc-by-1.0 | 70 | commons odc | (?:open data commons attribution licen[cs]e|odc by)(?: version| v)?(?: ?1 0)?
pddl-1.0 | 75 | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
pddl-1.0 | 70 | dedication pddl | (?:public domain dedication and licen[cs]e|pddl)(?: version| v)?(?: ?1 0)?
cdla-permissive-2.0 | 80 | community cdla | (?:community data license agreement permissive|cdla permissive)(?: version| v)? ?2 0
cdla-sharing-1.0 | 80 | community cdla | (?:community data license agreement sharing|cdla sharing)(?: version| v)? ?1 0
ogl-uk-3.0 | 85 | government | contains public sector information licensed under the open government licence v3 0
ogl-uk-3.0 | 70 | government | open government licence(?: version| v)? ?3(?: 0)?
ogl | 40 | government | open government licence
etalab-2.0 | 70 | etalab | (?:licence ouverte|etalab)(?: open licence)?(?: version| v)? ?2(?: 0)?
cc0-1.0 | 90 | waive | to the extent possible under law (?:[^ ]+ ){1,12}has waived all copyright and related or neighboring rights
cc0-1.0 | 85 | zero cc0 | (?:cc0|creative commons zero|cc zero)(?: version| v)? ?1 0(?: universal)?
cc0-1.0 | 75 | creativecommons | creativecommons org publicdomain zero 1 0
cc0-1.0 | 60 | zero cc0 | (?:cc0|creative commons zero|cc zero)
cc-pdm-1.0 | 75 | creativecommons | creativecommons org publicdomain mark 1 0
cc | 30 | creative | creative commons licen[cs]e
sspl-1.0 | 85 | server sspl | (?:server side public licen[cs]e|sspl)(?: version| v)? ?1(?: 0)?
sspl-1.0 | 40 | server | server side public licen[cs]e
elastic-2.0 | 85 | elastic | elastic licen[cs]e(?: version| v)? ?2(?: 0)?
elastic | 40 | elastic | elastic licen[cs]e
commons-clause | 85 | commons | commons clause(?: licen[cs]e)?(?: condition)?(?: version| v)?(?: ?1 0)?
polyform-noncommercial-1.0.0 | 80 | polyform | polyform noncommercial licen[cs]e 1 0 0
polyform-small-business-1.0.0 | 80 | polyform | polyform small business licen[cs]e 1 0 0
blueoak-1.0.0 | 80 | oak | blue oak model licen[cs]e(?: version| v)? ?1 0 0
upl-1.0 | 80 | universal upl | universal permissive licen[cs]e(?: upl)?(?: version| v)? ?1 0
ecl-2.0 | 80 | educational | educational community licen[cs]e(?: version| v)? ?2 0
lppl-1.3c | 85 | latex lppl | latex project public licen[cs]e(?: either)?(?: version| v)? ?1 3c?
lppl | 40 | latex lppl | (?:latex project public licen[cs]e|lppl)
w3c | 80 | w3c | w3c software(?: notice)? (?:and|and document notice and) licen[cs]e
vim | 80 | vim | (?:under the )?vim licen[cs]e
zpl-2.1 | 80 | zope zpl | (?:zope public licen[cs]e|zpl)(?: version| v)? ?2 1
apsl-2.0 | 80 | apple | apple public source licen[cs]e(?: version| v)? ?2 0
mulanpsl-2.0 | 80 | mulan mulanpsl | (?:mulan permissive software licen[cs]e|mulan psl|mulanpsl)(?: version| v)? ?2
nasa-1.3 | 80 | nasa | nasa open source agreement(?: version| v)? ?1 3
qpl-1.0 | 80 | qpl public | q public licen[cs]e(?: version| v)? ?1 0
sleepycat | 70 | sleepycat | sleepycat licen[cs]e
tcl | 70 | tcl | tcl tk licen[cs]e
curl | 70 | curl | curl licen[cs]e
json | 90 | evil | the software shall be used for good not evil
beerware | 90 | beer | you can buy me a beer in return
beerware | 70 | beerware | beerware licen[cs]e
ijg | 90 | jpeg | this software is based in part on the work of the independent jpeg group
freetype | 85 | freetype | (?:portions of this software are copyright [^ ]+(?: [^ ]+)? the freetype project|freetype licen[cs]e)
unicode | 85 | unicode | unicode(?: inc)? licen[cs]e agreement data files and software
llama-community | 85 | llama | llama (?:[0-9]+(?: [0-9]+)? )?community licen[cs]e(?: agreement)?
gemma | 80 | gemma | gemma terms of use
bigscience-rail-1.0 | 80 | rail | (?:bigscience|bigcode) (?:open )?rail(?: m)?(?: licen[cs]e)?(?: version| v)?(?: ?1(?: 0)?)?
openrail | 80 | openrail rail | (?:creativeml )?open ?rail(?: m)?(?: licen[cs]e)?
hippocratic-2.1 | 80 | hippocratic | hippocratic licen[cs]e(?: version| v)? ?2 1
public-domain | 55 | domain | (?:released|placed|dedicated|put|donated) (?:in ?to|to|in) the public domain
public-domain | 50 | domain | (?:is|are) in the public domain
public-domain | 50 | copyright | no copyright (?:is claimed|claimed|restrictions)
public-domain | 50 | government | work of the (?:united states|u s|us) government
public-domain | 20 | domain | public domain
proprietary | 55 | proprietary confidential | (?:proprietary and confidential|confidential and proprietary)(?: information)?
proprietary | 55 | unauthorized unauthorised | unauthori[sz]ed (?:copying|use|reproduction|distribution)(?: or distribution)?(?: of this (?:file|software|document|material))?
proprietary | 50 | permission | may not be (?:reproduced|copied|distributed|redistributed)(?: [^ ]+){0,8} without (?:the )?(?:prior |express |written )+(?:permission|consent)
proprietary | 50 | trade | contains trade secrets
proprietary | 45 | personal | for personal(?: and)? non ?commercial use only
noncommercial | 45 | commercial noncommercial | (?:for )?non ?commercial (?:use|purposes)(?: only)?
no-derivatives | 45 | derivative | no derivative works?(?: are)?(?: permitted| allowed)?
evaluation | 45 | evaluation | for evaluation purposes only
academic-use | 45 | academic research | (?:academic|research) (?:use|purposes) only
reserved | 40 | reserved | (?:all|some|no) rights(?: are)? reserved
reserved | 40 | réservés | tous droits réservés
reserved | 40 | vorbehalten | alle rechte vorbehalten
reserved | 40 | reservados | todos los derechos reservados
reserved | 40 | riservati | tutti i diritti riservati
copyright | 30 | copyright © | (?:copyright|©) (?:c |© )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
copyright | 25 | copyright | copyright (?:notice|holders?|owners?)
trademark | 25 | trademark trademarks | (?:registered )?trademarks? of (?:their|its) respective (?:owners?|holders?)
warranty-disclaimer | 26 | warranty warranties | (?:as is )?without warrant(?:y|ies) (?:or conditions )?of any kind
warranty-disclaimer | 26 | merchantability | implied warrant(?:y|ies) of merchantability(?: (?:and|or) fitness for a particular purpose)?
liability-disclaimer | 26 | liable | in no event shall (?:[^ ]+ ){1,8}be liable
permissive-unknown | 20 | under | (?:is |are )?(?:licensed|released|distributed) under (?:an? )?(?:open ?source|permissive|free) licen[cs]e
see-license | 20 | license licence | see (?:the )?(?:accompanying )?licen[cs]e(?: file)?(?: for (?:more )?(?:details|information))?
dual-license | 30 | dual dually | dual(?:ly)? licen[cs]ed
"""


def signatures() -> list[tuple[str, str, str, int]]:
    """(label, pattern, keywords, priority) of every rule, in order: signatures, identifiers, Creative Commons."""
    out = []
    for line in SIGNATURES.strip().split("\n"):
        label, priority, keywords, pattern = line.split(" | ", 3)
        out.append((label, pattern, keywords, int(priority)))
    folded = lambda x: " ".join(x.replace(".", " ").replace("-", " ").split())
    for name in IDENTIFIERS:
        out.append((name, rf"spdx licen[cs]e identifier {folded(name)}", "spdx", 95))
        if "gpl" in name:
            out += [(f"{name}-{end}", rf"spdx licen[cs]e identifier {folded(name)} {folded(end)}", "spdx", 96) for end in ("only", "or-later")]
    for e in CC_ELEMENTS:
        parts = e.split("-")
        said = f"(?:cc {' '.join(parts)}|creative commons {' '.join(CC_NAMES[p] for p in parts)})(?: (?:international|unported|generic))?(?: licen[cs]e)?"
        for v in CC_VERSIONS:
            out.append((f"cc-{e}-{v}", rf"{said} (?:version |v ?)?{folded(v)}", "cc creative", 80))
            out.append((f"cc-{e}-{v}", rf"creativecommons org licenses {' '.join(parts)} {folded(v)}", "creativecommons", 90))
        out.append((f"cc-{e}", said, "cc creative", 45 + len(parts)))
    return out
