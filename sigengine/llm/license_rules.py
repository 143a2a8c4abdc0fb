"""Signatures of licenses, in order of priority.

A line ``@ a | b`` opens a group that runs only on texts that hold one of its keywords. Each other line is a label, how sure
a match makes it (0 to 1) and a regular expression over lower-case words joined by single spaces. An earlier line goes before
a later one where matches lie within each other: texts of licenses first, then notices, then identifiers, then names.
"""

SIGNATURES = r"""
@ affero | agpl
agpl-3 0.99 this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
agpl-3 0.98 gnu affero general public license version 3 19 november 2007
agpl-3 0.97 remote network interaction use with the gnu general public license notwithstanding any other provision of this license affero
agpl-1 0.96 affero general public license version 1(?: march 2002)?
agpl-3 0.96 spdx license identifier agpl 3 0(?: only| or later)?
agpl-1 0.96 spdx license identifier agpl 1 0(?: only| or later)?
agpl-3 0.95 (?:gnu )?affero general public license (?:v|version )3(?: 0)?(?: or later)?
agpl-3 0.95 (?:gnu )?agpl ?v?3(?: 0)?(?: or later| only)?
agpl-3 0.9 licen[cs]ed under (?:the )?(?:gnu )?(?:agpl|affero general public license)
agpl 0.85 under (?:the )?(?:terms of (?:the )?)?(?:gnu )?affero general public license
agpl 0.8 gnu affero general public license
agpl 0.7 affero (?:general public )?license
agpl 0.7 agpl(?: license)?

@ lesser general | library general | lgpl
lgpl-3 0.99 this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license
lgpl-2.1 0.99 this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license
lgpl-3 0.99 you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license
lgpl-2 0.99 under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license
lgpl-2.1 0.98 gnu lesser general public license version 2 1 february 1999
lgpl-3 0.98 gnu lesser general public license version 3 29 june 2007
lgpl-2 0.98 gnu library general public license version 2 june 1991
lgpl-2.1 0.96 spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3 0.96 spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2 0.96 spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1 0.95 (?:gnu )?lesser general public license (?:v|version )?2 1(?: or later)?
lgpl-3 0.95 (?:gnu )?lesser general public license (?:v|version )?3(?: 0)?(?: or later)?
lgpl-2 0.95 (?:gnu )?library general public license (?:v|version )?2(?: 0)?
lgpl-2.1 0.94 (?:gnu )?lgpl ?v?2 1(?: or later| only)?
lgpl-3 0.94 (?:gnu )?lgpl ?v?3(?: 0)?(?: or later| only)?
lgpl-2 0.94 (?:gnu )?lgpl ?v?2(?: 0)?
lgpl 0.8 (?:gnu )?lesser general public license
lgpl 0.8 gnu library general public license
lgpl 0.75 (?:licen[cs]ed )?under (?:the )?lgpl(?: license)?
lgpl 0.6 lgpl

@ general public license | gpl | free software foundation | copyleft license for software
gpl-2 0.99 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license
gpl-3 0.99 this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license
gpl-2 0.99 under the terms of the gnu general public license version 2 as published by the free software foundation
gpl-3 0.99 under the terms of the gnu general public license version 3 as published by the free software foundation
gpl-3 0.99 the gnu general public license is a free copyleft license for software and other kinds of works
gpl-1 0.98 gnu general public license version 1 february 1989
gpl-2 0.98 gnu general public license version 2 june 1991
gpl-3 0.98 gnu general public license version 3 29 june 2007
gpl-2-classpath 0.97 gnu general public license version 2 with (?:the )?classpath exception
gpl-2-classpath 0.97 spdx license identifier gpl 2 0(?: only| or later)? with classpath exception 2 0
gpl-2 0.96 spdx license identifier gpl 2 0(?: only| or later)?
gpl-3 0.96 spdx license identifier gpl 3 0(?: only| or later)?
gpl-1 0.96 spdx license identifier gpl 1 0(?: only| or later)?
gpl-2 0.95 (?:gnu )?general public license (?:v|version )?2(?: 0)?(?: or later)?
gpl-3 0.95 (?:gnu )?general public license (?:v|version )?3(?: 0)?(?: or later)?
gpl-2 0.94 (?:gnu )?gpl ?v?2(?: 0)?(?: or later| only)?
gpl-3 0.94 (?:gnu )?gpl ?v?3(?: 0)?(?: or later| only)?
gpl-2 0.94 gpl version 2(?: 0)?(?: or later)?
gpl-3 0.94 gpl version 3(?: 0)?(?: or later)?
gpl 0.9 you should have received a copy of the gnu general public license along with this program
gpl 0.85 released under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public license)
gpl 0.85 licen[cs]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public license)
gpl 0.85 distributed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?(?:gpl|general public license)
gpl 0.8 gnu general public license
gpl 0.7 (?:gnu )?gpl(?: license)?
gfdl-1.3 0.96 spdx license identifier gfdl 1 3(?: only| or later)? free software foundation

@ free documentation license | gfdl
gfdl-1.3 0.99 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 3
gfdl-1.2 0.99 permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license version 1 2
gfdl-1.3 0.95 gnu free documentation license (?:v|version )?1 3
gfdl-1.2 0.95 gnu free documentation license (?:v|version )?1 2
gfdl 0.8 (?:gnu )?free documentation license
gfdl 0.7 (?:gnu )?gfdl

@ apache | unless required by applicable law
apache-2 0.99 licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2 0.99 apache license version 2 0 january 2004
apache-2 0.97 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1 0.98 the apache software license version 1 1
apache-1.1 0.97 this product includes software developed by the apache software foundation
apache-1 0.97 this product includes software developed by the apache group for use in the apache http server project
apache-2-llvm 0.97 apache license (?:v|version )?2 0 with llvm exceptions?
apache-2-llvm 0.97 spdx license identifier apache 2 0 with llvm exception
apache-2 0.96 spdx license identifier apache 2 0
apache-1.1 0.96 spdx license identifier apache 1 1
apache-2 0.95 apache (?:software )?licen[cs]e (?:v|version )?2(?: 0)?
apache-1.1 0.95 apache (?:software )?licen[cs]e (?:v|version )?1 1
apache-2 0.93 apache ?v?2(?: 0)? licen[cs]e
apache-2 0.93 (?:under|is) (?:the )?apache 2(?: 0)?
apache 0.85 licen[cs]ed under (?:the )?(?:terms of (?:the )?)?apache
apache 0.8 apache (?:software )?licen[cs]e

@ permission is hereby granted | permission notice | mit | expat
mit-0 0.99 mit no attribution
mit-modern 0.98 permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software
x11-distribute 0.98 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute distribute with modifications
mit 0.99 permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit 0.97 the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0 0.96 spdx license identifier mit 0
mit 0.96 spdx license identifier mit
mit 0.95 (?:licen[cs]ed|released|distributed|available|published|provided) under (?:the )?(?:terms of (?:the )?)?(?:mit|expat)(?: licen[cs]e)?
mit 0.93 under (?:the )?terms of (?:the )?(?:mit|expat) licen[cs]e
mit 0.92 subject to (?:the )?(?:mit|expat) licen[cs]e
mit 0.9 (?:the )?(?:mit|expat) licen[cs]e
mit 0.85 licen[cs]e (?:is )?(?:mit|expat)
mit 0.85 mit licen[cs]ed

@ x consortium | x11 | xfree86
x11 0.98 except as contained in this notice the name of the x consortium shall not be used in advertising
xfree86 0.97 xfree86 licen[cs]e(?: version 1 1| 1 1)?
x11 0.96 spdx license identifier x11
x11 0.9 (?:the )?x11 licen[cs]e

@ redistribution and use in source and binary forms | redistributions | bsd | neither the name
bsd-4 0.99 all advertising materials mentioning features or use of this software must display the following acknowledgement redistributions
bsd-3 0.98 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 0.97 neither the name of (?:the university|the author|the company|the project) nor the names of (?:its|other|the) contributors may be used to endorse or promote products
bsd-2 0.93 redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd-2 0.9 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation
bsd-2 0.9 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd-0 0.96 spdx license identifier 0bsd
bsd-2-patent 0.97 spdx license identifier bsd 2 clause patent
bsd-2 0.96 spdx license identifier bsd 2 clause
bsd-3-clear 0.97 spdx license identifier bsd 3 clause clear
bsd-3 0.96 spdx license identifier bsd 3 clause
bsd-4 0.96 spdx license identifier bsd 4 clause
bsd-0 0.95 zero clause bsd(?: licen[cs]e)?
bsd-2 0.95 (?:2|two) clause bsd(?: licen[cs]e)?
bsd-2 0.95 bsd (?:2|two) clause(?: licen[cs]e)?
bsd-2 0.94 (?:simplified|freebsd) bsd licen[cs]e
bsd-3-clear 0.95 clear bsd licen[cs]e
bsd-3 0.95 (?:3|three) clause bsd(?: licen[cs]e)?
bsd-3 0.95 bsd (?:3|three) clause(?: licen[cs]e)?
bsd-3 0.94 (?:new|revised|modified) bsd licen[cs]e
bsd-4 0.95 (?:4|four) clause bsd(?: licen[cs]e)?
bsd-4 0.95 bsd (?:4|four) clause(?: licen[cs]e)?
bsd-4 0.94 (?:original|old) bsd licen[cs]e
bsd 0.85 (?:licen[cs]ed|released|distributed|available) under (?:the |a )?(?:terms of (?:the |a )?)?bsd(?: style)?
bsd 0.8 bsd(?: style)? licen[cs]e

@ permission to use copy modify | isc | internet systems consortium | internet software consortium
isc 0.98 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
bsd-0 0.97 permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd 0.95 permission to use copy modify and distribute this software and its documentation for any purpose
isc 0.96 spdx license identifier isc
isc 0.93 (?:the )?isc licen[cs]e
isc 0.9 licen[cs]ed under (?:the )?isc

@ mozilla | mpl
mpl-2 0.99 this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1 0.99 the contents of this file are subject to the mozilla public license version 1 1
mpl-1 0.99 the contents of this file are subject to the mozilla public license version 1 0
mpl-2-no-copyleft 0.97 spdx license identifier mpl 2 0 no copyleft exception
mpl-2 0.96 spdx license identifier mpl 2 0
mpl-1.1 0.96 spdx license identifier mpl 1 1
mpl-2 0.95 mozilla public licen[cs]e (?:v ?|version )?2(?: 0)?
mpl-1.1 0.95 mozilla public licen[cs]e (?:v ?|version )?1 1
mpl-2 0.93 mpl ?v?2(?: 0)?
mpl-1.1 0.93 mpl ?v?1 1
mpl 0.8 mozilla public licen[cs]e

@ eclipse | epl | common public license | ibm public license
epl-2 0.99 this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0
epl-1 0.99 this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?1 0
edl-1 0.96 eclipse distribution licen[cs]e (?:v ?|version )?1 0
epl-2 0.96 spdx license identifier epl 2 0
epl-1 0.96 spdx license identifier epl 1 0
epl-2 0.95 eclipse public licen[cs]e (?:v ?|version )?2(?: 0)?
epl-1 0.95 eclipse public licen[cs]e (?:v ?|version )?1(?: 0)?
epl 0.8 eclipse public licen[cs]e
cpl-1 0.95 common public license (?:v ?|version )?1 0
cpl-1 0.85 common public license
ipl-1 0.95 ibm public license (?:v ?|version )?1 0

@ common development and distribution | cddl
cddl-1.1 0.98 the contents of this file are subject to the terms of the common development and distribution license
cddl-1.1 0.96 spdx license identifier cddl 1 1
cddl-1 0.96 spdx license identifier cddl 1 0
cddl-1.1 0.95 common development and distribution licen[cs]e (?:cddl )?(?:v ?|version )?1 1
cddl-1 0.95 common development and distribution licen[cs]e (?:cddl )?(?:v ?|version )?1 0
cddl 0.85 common development and distribution licen[cs]e
cddl 0.7 cddl

@ european union public | eupl
eupl-1.2 0.98 licen[cs]ed under the eupl(?: version 1 2| v 1 2| 1 2)
eupl-1.2 0.96 spdx license identifier eupl 1 2
eupl-1.1 0.96 spdx license identifier eupl 1 1
eupl-1.2 0.95 european union public licen[cs]e (?:v ?|version )?1 2
eupl-1.1 0.95 european union public licen[cs]e (?:v ?|version )?1 1
eupl 0.85 european union public licen[cs]e
eupl 0.7 eupl

@ cc0 | creative commons zero | waived all copyright
cc0 0.99 the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights cc0
cc0 0.97 to the extent possible under law the author(?: s)? (?:has|have) waived all copyright
cc0 0.96 spdx license identifier cc0 1 0
cc0 0.95 creative commons zero(?: v ?1 0| 1 0)?(?: universal)?
cc0 0.95 creativecommons org publicdomain zero 1 0 cc0
cc0 0.9 cc0(?: 1 0)?(?: universal)?

@ creative commons | creativecommons | cc by
cc-by-nc-nd 0.98 creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: works)?(?: [1234] 0)?(?: international| unported| generic)?
cc-by-nc-sa 0.98 creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: international| unported| generic)?
cc-by-nc 0.97 creative commons attribution non ?commercial(?: [1234] 0)?(?: international| unported| generic)?
cc-by-nd 0.97 creative commons attribution no ?deriv(?:ative|atives|s)(?: works)?(?: [1234] 0)?(?: international| unported| generic)?
cc-by-sa 0.97 creative commons attribution share ?alike(?: [1234] 0)?(?: international| unported| generic)?
cc-by 0.95 creative commons attribution(?: [1234] 0)?(?: international| unported| generic)?
cc-by-nc-nd 0.97 creativecommons org licenses by nc nd(?: [1234] 0)?
cc-by-nc-sa 0.97 creativecommons org licenses by nc sa(?: [1234] 0)?
cc-by-nc 0.96 creativecommons org licenses by nc(?: [1234] 0)?
cc-by-nd 0.96 creativecommons org licenses by nd(?: [1234] 0)?
cc-by-sa 0.96 creativecommons org licenses by sa(?: [1234] 0)?
cc-by 0.95 creativecommons org licenses by(?: [1234] 0)?
cc-by-nc-nd 0.96 cc by nc nd(?: [1234] 0)?
cc-by-nc-sa 0.96 cc by nc sa(?: [1234] 0)?
cc-by-nc 0.95 cc by nc(?: [1234] 0)?
cc-by-nd 0.95 cc by nd(?: [1234] 0)?
cc-by-sa 0.95 cc by sa(?: [1234] 0)?
cc-by 0.9 cc by(?: [1234] 0)?
cc 0.7 licen[cs]ed under a creative commons licen[cs]e
cc 0.7 creative commons licen[cs]e

@ unencumbered software | unlicense
unlicense 0.99 this is free and unencumbered software released into the public domain
unlicense 0.97 for more information please refer to http(?:s)? unlicense org
unlicense 0.96 spdx license identifier unlicense
unlicense 0.85 (?:the )?unlicense

@ what the fuck | wtfpl
wtfpl 0.99 do what the fuck you want to public license
wtfpl 0.96 spdx license identifier wtfpl
wtfpl 0.85 wtfpl(?: licen[cs]e)?

@ zlib | in no event will the authors be held liable
zlib 0.97 this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib 0.96 spdx license identifier zlib
zlib-libpng 0.95 zlib libpng licen[cs]e
zlib 0.93 zlib licen[cs]e
zlib 0.9 licen[cs]ed under (?:the )?zlib

@ boost | bsl
boost-1 0.99 permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license boost
boost-1 0.98 distributed under the boost software license version 1 0
boost-1 0.96 spdx license identifier bsl 1 0
boost-1 0.95 boost software licen[cs]e(?: version 1 0| v ?1 0| 1 0)?

@ business source | busl
busl-1.1 0.97 business source licen[cs]e (?:v ?|version )?1 1
busl-1.1 0.96 spdx license identifier busl 1 1
busl-1.1 0.85 business source licen[cs]e

@ artistic | same terms as perl
artistic-1 0.97 you can redistribute it and or modify it under the same terms as perl itself
artistic-2 0.96 spdx license identifier artistic 2 0
artistic-1 0.96 spdx license identifier artistic 1 0
artistic-2 0.95 (?:the )?artistic licen[cs]e (?:v ?|version )?2(?: 0)?
artistic-1 0.95 (?:the )?artistic licen[cs]e (?:v ?|version )?1(?: 0)?
artistic 0.8 (?:the )?artistic licen[cs]e

@ postgresql | php license | python software foundation | psf | ruby license | ruby s license
postgresql 0.96 spdx license identifier postgresql
postgresql 0.9 (?:the )?postgresql licen[cs]e
php-3.01 0.95 php license (?:v ?|version )?3 01
php-3 0.85 php license
python-2 0.96 spdx license identifier (?:python 2 0|psf 2 0) psf
python-2 0.95 python software foundation license(?: version 2| v ?2| 2)?
python-2 0.9 psf license(?: version 2| 2)?
ruby 0.9 ruby(?: s)? license

@ open font | ofl
ofl-1.1 0.99 this font software is licensed under the sil open font license version 1 1
ofl-1.1 0.96 spdx license identifier ofl 1 1
ofl-1.1 0.93 (?:sil )?open font licen[cs]e(?: version 1 1| v ?1 1| 1 1)?

@ open database | odbl | open data commons | odc by | pddl
odbl 0.97 made available under the open database license
odbl 0.96 spdx license identifier odbl 1 0
odbl 0.93 open database licen[cs]e(?: odbl)?(?: v ?1 0| 1 0)?
odc-by 0.95 open data commons attribution licen[cs]e(?: v ?1 0| 1 0)?
pddl 0.95 open data commons public domain dedication and licen[cs]e
odc-by 0.9 odc by(?: 1 0)?

@ sspl | server side public | elastic license | commons clause | prosperity | polyform
sspl-1 0.97 server side public licen[cs]e(?: version 1| v ?1| 1)?
sspl-1 0.85 sspl(?: v?1| 1 0)?
elastic-2 0.95 elastic license (?:v ?|version )?2(?: 0)?
elastic-2 0.85 elastic license
commons-clause 0.95 commons clause(?: licen[cs]e)?(?: condition)?(?: v ?1 0)?
polyform-noncommercial 0.95 polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform 0.85 polyform (?:small business|shield|strict|perimeter)

@ open government | crown copyright
ogl-3 0.97 contains public sector information licensed under the open government licence v ?3 0
ogl-3 0.95 open government licen[cs]e (?:v ?|version )?3(?: 0)?
ogl 0.85 open government licen[cs]e
crown 0.8 crown copyright

@ llama | openrail | rail licen | gemma terms
llama-3 0.95 (?:meta )?llama 3(?: [123])? community license(?: agreement)?
llama-2 0.95 llama 2 community license(?: agreement)?
openrail-m 0.93 (?:creativeml |bigscience |bigcode )?openrail m(?: licen[cs]e)?
openrail 0.85 openrail
rail 0.85 (?:bigscience )?rail licen[cs]e(?: 1 0)?
gemma 0.9 gemma terms of use

@ microsoft | ms pl | ms rl
ms-pl 0.95 microsoft public licen[cs]e(?: ms pl)?
ms-rl 0.95 microsoft reciprocal licen[cs]e(?: ms rl)?
ms-pl 0.9 spdx license identifier ms pl

@ academic free | afl | open software license | osl 3 | ncsa | openssl | vim license | beerware | json license | shall be used for good
afl-3 0.95 academic free licen[cs]e(?: version 3 0| v ?3 0| 3 0)?
afl-3 0.93 afl 3 0
osl-3 0.95 open software license (?:v ?|version )?3 0
osl-3 0.93 osl 3 0
ncsa 0.95 university of illinois ncsa open source licen[cs]e
ncsa 0.85 ncsa licen[cs]e
openssl 0.97 this product includes software developed by the openssl project
openssl 0.9 openssl licen[cs]e
vim 0.9 vim license
beerware 0.95 beerware licen[cs]e(?: revision 42)?
json 0.95 the software shall be used for good not evil
json 0.85 json license

@ public domain
public-domain 0.95 (?:dedicated|released|placed) (?:in|into|to) the public domain
public-domain 0.9 (?:this|the) (?:work|file|code|software|text|document) is in the public domain
public-domain 0.6 public domain

@ all rights reserved | proprietary | confidential
proprietary 0.95 proprietary and confidential
proprietary 0.93 unauthorized copying of this file via any medium is strictly prohibited proprietary
proprietary 0.93 spdx license identifier proprietary
proprietary 0.85 proprietary licen[cs]e
proprietary 0.8 this software is (?:proprietary|confidential)
proprietary 0.6 all rights reserved
"""
