"""The rules of the licence scan: one block a label, one line a rule.

A rule is its level, its keyword and a pattern over the words of a text (A-Z lower-cased, one space between
words, all other signs gone). A text without the keyword is never searched for the pattern. Levels, strongest first:
5 wording of a licence, 4 machine-readable tag, 3 notice with a grant, 2 name with its version, 1 name, 0 address or short name.
A star marks the places that the contract fixes; they are never suppressed. Rules that stand earlier win between equals.
"""

RULES = r"""
mit
  * mit: under the mit license
  5 hereby: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)? to deal in the software without restriction
  4 spdx: spdx license identifier mit
  3 mit: (?:re)?(?:licensed|released|distributed|published|available|provided)( \S+){0,2} (?:under|with) the (?:terms of the )?mit (?:public )?licen[cs]e
  3 mit: subject to the (?:terms of the )?mit licen[cs]e
  1 mit: mit (?:open source |style |x11 )?licen[cs]e
  1 expat: expat licen[cs]e
  1 licencia: licencia mit
  1 lizenz: mit lizenz
  0 mit: licenses mit(?: html)?
mit-0
  4 spdx: spdx license identifier mit 0
  1 mit: mit no attribution(?: licen[cs]e)?
x11
  4 spdx: spdx license identifier x11
  1 x11: x11 licen[cs]e
apache-2
  * apache: apache license version 2
  5 apache: licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
  4 spdx: spdx license identifier apache 2 0
  3 apache: (?:licensed|released|distributed|available|provided)( \S+){0,2} under (?:the )?(?:terms of (?:the )?)?apache (?:software )?(?:licen[cs]e )?(?:version |v ?)?2(?: 0)?(?: licen[cs]e)?
  2 apache: apache (?:software |public )?licen[cs]e (?:version |v)?2(?: 0)?
  2 apache: apache licen[cs]e v2(?: 0)?
  2 apache: apache 2(?: 0)?(?: licen[cs]e)?
  2 asl: asl 2 0
  0 apache: apache org licenses license 2 0(?: txt| html)?
apache-1.1
  4 spdx: spdx license identifier apache 1 1
  2 apache: apache (?:software )?licen[cs]e (?:version )?1 1
  5 apache: this product includes software developed by the apache software foundation
apache-1.0
  4 spdx: spdx license identifier apache 1 0
  2 apache: apache (?:software )?licen[cs]e (?:version )?1 0
apache
  1 apache: apache (?:software |public )?licen[cs]e
gpl-3
  5 gnu: gnu general public license version 3 29 june 2007
  4 spdx: spdx license identifier gpl 3 0(?: only| or later)?
  3 gnu: under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
  3 gnu: (?:licensed|released|distributed|available)( \S+){0,2} under the gnu (?:general public licen[cs]e|gpl)(?: \S+){0,2} version 3(?: 0)?
  2 gnu: gnu (?:general public licen[cs]e|gpl) (?:version |v ?)?3(?: 0)?
  2 gnu: gnu (?:general public licen[cs]e|gpl) v3(?: 0)?
  2 gplv3: (?:gnu )?gplv3
  2 gpl: gpl (?:version |v ?)?3(?: 0)?(?: only| or later)?
  2 gpl: gpl v3(?: 0)?
  0 gnu: gnu org licenses gpl 3 0(?: txt| html)?
gpl-2
  5 gnu: gnu general public license version 2 june 1991
  4 spdx: spdx license identifier gpl 2 0(?: only| or later)?
  3 gnu: under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
  3 gnu: (?:licensed|released|distributed|available)( \S+){0,2} under the gnu (?:general public licen[cs]e|gpl)(?: \S+){0,2} version 2(?: 0)?
  2 gnu: gnu (?:general public licen[cs]e|gpl) (?:version |v ?)?2(?: 0)?
  2 gnu: gnu (?:general public licen[cs]e|gpl) v2(?: 0)?
  2 gplv2: (?:gnu )?gplv2
  2 gpl: gpl (?:version |v ?)?2(?: 0)?(?: only| or later)?
  2 gpl: gpl v2(?: 0)?
  0 gnu: gnu org licenses (?:old licenses )?gpl 2 0(?: txt| html)?
gpl-1
  4 spdx: spdx license identifier gpl 1 0(?: only| or later)?
  2 gnu: gnu general public licen[cs]e (?:version |v ?)?1(?: 0)?
gpl
  3 gnu: (?:licensed|released|distributed|available)( \S+){0,2} under (?:the )?(?:terms of the )?gnu (?:general public licen[cs]e|gpl)
  1 gnu: gnu general public licen[cs]e
  1 gnu: gnu gpl
  1 gpl: gpl licen[cs]ed?
  1 licence: licence publique générale gnu
  1 licencia: licencia pública general (?:de )?gnu
lgpl-3
  5 lesser: gnu lesser general public license version 3 29 june 2007
  4 spdx: spdx license identifier lgpl 3 0(?: only| or later)?
  2 lesser: gnu lesser general public licen[cs]e (?:version |v ?)?3(?: 0)?
  2 lgpl: (?:gnu )?lgpl (?:version |v ?)?3(?: 0)?
  2 lgplv3: (?:gnu )?lgplv3
lgpl-2.1
  5 lesser: gnu lesser general public license version 2 1 february 1999
  4 spdx: spdx license identifier lgpl 2 1(?: only| or later)?
  2 lesser: gnu lesser general public licen[cs]e (?:version |v ?)?2 1
  2 lgpl: (?:gnu )?lgpl (?:version |v ?)?2 1
lgpl-2
  5 library: gnu library general public license version 2 june 1991
  4 spdx: spdx license identifier lgpl 2 0(?: only| or later)?
  2 library: gnu library general public licen[cs]e(?: (?:version |v ?)?2(?: 0)?)?
lgpl
  1 lesser: gnu lesser general public licen[cs]e
  1 lgpl: (?:gnu )?lgpl(?: licen[cs]ed?)?
agpl-3
  5 affero: gnu affero general public license version 3 19 november 2007
  4 spdx: spdx license identifier agpl 3 0(?: only| or later)?
  2 affero: gnu affero general public licen[cs]e (?:version |v ?)?3(?: 0)?
  2 agpl: (?:gnu )?agpl (?:version |v ?)?3(?: 0)?
  2 agplv3: (?:gnu )?agplv3
agpl
  1 affero: (?:gnu )?affero general public licen[cs]e
  1 agpl: (?:gnu )?agpl(?: licen[cs]ed?)?
gfdl
  5 documentation: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
  4 spdx: spdx license identifier gfdl 1 [123](?: only| or later)?
  2 documentation: gnu free documentation licen[cs]e (?:version )?1 [123]
  1 documentation: gnu free documentation licen[cs]e
  1 gfdl: gfdl
bsd-2
  5 redistributions: redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided
  4 spdx: spdx license identifier bsd 2 clause
  2 bsd: (?:simplified|freebsd|2 clause|two clause) bsd(?: licen[cs]e)?
  2 bsd: bsd 2 clause(?: licen[cs]e)?
bsd-3
  5 redistributions: redistributions of source code must retain the above copyright notice (?:\S+ ){1,60}neither the name of
  4 spdx: spdx license identifier bsd 3 clause
  2 bsd: (?:new|modified|revised|3 clause|three clause) bsd(?: licen[cs]e)?
  2 bsd: bsd 3 clause(?: licen[cs]e)?
bsd-4
  5 advertising: all advertising materials mentioning features or use of this software must display the following acknowledge?ment
  4 spdx: spdx license identifier bsd 4 clause
  2 bsd: (?:original|4 clause|four clause) bsd(?: licen[cs]e)?
  2 bsd: bsd 4 clause(?: licen[cs]e)?
bsd-0
  4 spdx: spdx license identifier 0bsd
  2 bsd: (?:zero clause|0 clause) bsd(?: licen[cs]e)?
  2 0bsd: 0bsd
bsd
  3 bsd: (?:licensed|released|distributed|available)( \S+){0,2} under (?:the |a )?bsd (?:style )?licen[cs]e
  1 bsd: bsd (?:style )?licen[cs]e
  1 redistribution: redistribution and use in source and binary forms with or without modification are permitted
isc
  5 hereby: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
  4 spdx: spdx license identifier isc
  1 isc: isc licen[cs]e
mpl-2
  5 mozilla: this source code form is subject to the terms of the mozilla public license v 2 0
  4 spdx: spdx license identifier mpl 2 0
  2 mozilla: mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
  2 mpl: mpl (?:version |v ?)?2(?: 0)?
  0 mozilla: mozilla org mpl 2 0
mpl-1.1
  4 spdx: spdx license identifier mpl 1 1
  2 mozilla: mozilla public licen[cs]e (?:version |v ?)?1 1
  2 mpl: mpl (?:version |v ?)?1 1
mpl
  1 mozilla: mozilla public licen[cs]e
epl-2
  4 spdx: spdx license identifier epl 2 0
  2 eclipse: eclipse public licen[cs]e (?:version |v ?)?2(?: 0)?
  0 eclipse: eclipse org legal epl 2 0
epl-1
  4 spdx: spdx license identifier epl 1 0
  2 eclipse: eclipse public licen[cs]e (?:version |v ?)?1(?: 0)?
  0 eclipse: eclipse org legal epl v10(?: html)?
epl
  1 eclipse: eclipse public licen[cs]e
edl-1
  1 eclipse: eclipse distribution licen[cs]e(?: (?:version |v ?)?1(?: 0)?)?
cddl-1.1
  4 spdx: spdx license identifier cddl 1 1
  2 cddl: cddl (?:version )?1 1
cddl-1
  4 spdx: spdx license identifier cddl 1 0
  2 cddl: cddl (?:version )?1 0
  1 distribution: common development and distribution licen[cs]e
cpl-1
  4 spdx: spdx license identifier cpl 1 0
  1 common: common public licen[cs]e(?: (?:version |v ?)?1 0)?
cpal-1
  4 spdx: spdx license identifier cpal 1 0
  1 attribution: common public attribution licen[cs]e
artistic-2
  4 spdx: spdx license identifier artistic 2 0
  2 artistic: artistic licen[cs]e (?:version |v ?)?2(?: 0)?
artistic-1
  4 spdx: spdx license identifier artistic 1 0(?: perl| cl8)?
  2 artistic: artistic licen[cs]e (?:version |v ?)?1(?: 0)?
artistic
  1 artistic: artistic licen[cs]e
  3 perl: (?:under|on) the same terms as perl itself
zlib
  5 altered: altered source versions must be plainly marked as such and must not be misrepresented as being the original software
  4 spdx: spdx license identifier zlib
  1 zlib: zlib(?: libpng)? licen[cs]e
libpng
  4 spdx: spdx license identifier libpng(?: 2 0)?
  1 libpng: libpng licen[cs]e
bsl-1
  5 boost: distributed under the boost software license version 1 0
  4 spdx: spdx license identifier bsl 1 0
  1 boost: boost software licen[cs]e(?: (?:version )?1 0)?
  0 boost: boost org license 1 0 txt
busl-1.1
  4 spdx: spdx license identifier busl 1 1
  1 business: business source licen[cs]e(?: (?:version )?1 1)?
unlicense
  5 unencumbered: this is free and unencumbered software released into the public domain
  4 spdx: spdx license identifier unlicense
  1 unlicense: the unlicense
  0 unlicense: unlicense org
wtfpl
  4 spdx: spdx license identifier wtfpl
  1 wtfpl: wtfpl
  1 fuck: do what the fuck you want to public licen[cs]e
beerware
  4 spdx: spdx license identifier beerware
  1 beerware: beerware licen[cs]e
  1 beer: the beer ware licen[cs]e
cc0
  4 spdx: spdx license identifier cc0 1 0
  3 waived: waived all copyright and related or neighboring rights
  2 cc0: cc0(?: (?:version )?1 0)?(?: universal)?
  1 creative: creative commons zero
  0 publicdomain: creativecommons org publicdomain zero 1 0
cc-pdm
  1 domain: creative commons public domain mark
  0 publicdomain: creativecommons org publicdomain mark 1 0
cc-by-nc-nd
  4 spdx: spdx license identifier cc by nc nd [1-4] [05]
  2 cc: cc by nc nd(?: [1-4] [05])?
  1 noderivatives: (?:creative commons )?attribution non ?commercial noderivatives(?: [1-4] [05])?(?: international| unported)?
  1 derivatives: (?:creative commons )?attribution non ?commercial no derivatives(?: [1-4] [05])?(?: international| unported)?
  0 nc: creativecommons org licenses by nc nd(?: [1-4] [05])?
cc-by-nc-sa
  4 spdx: spdx license identifier cc by nc sa [1-4] [05]
  2 cc: cc by nc sa(?: [1-4] [05])?
  1 sharealike: (?:creative commons )?attribution non ?commercial sharealike(?: [1-4] [05])?(?: international| unported)?
  1 alike: (?:creative commons )?attribution non ?commercial share alike(?: [1-4] [05])?(?: international| unported)?
  0 nc: creativecommons org licenses by nc sa(?: [1-4] [05])?
cc-by-nc
  * cc: cc by nc
  4 spdx: spdx license identifier cc by nc [1-4] [05]
  2 cc: cc by nc(?: [1-4] [05])?
  1 noncommercial: (?:creative commons )?attribution noncommercial(?: [1-4] [05])?(?: international| unported)?
  1 commercial: creative commons attribution non commercial(?: [1-4] [05])?(?: international| unported)?
  0 nc: creativecommons org licenses by nc(?: [1-4] [05])?
cc-by-nd
  4 spdx: spdx license identifier cc by nd [1-4] [05]
  2 cc: cc by nd(?: [1-4] [05])?
  1 noderivatives: creative commons attribution noderivatives(?: [1-4] [05])?(?: international| unported)?
  1 derivatives: creative commons attribution no derivatives(?: [1-4] [05])?(?: international| unported)?
  0 nd: creativecommons org licenses by nd(?: [1-4] [05])?
cc-by-sa
  4 spdx: spdx license identifier cc by sa [1-4] [05]
  2 cc: cc by sa(?: [1-4] [05])?
  1 sharealike: creative commons attribution sharealike(?: [1-4] [05])?(?: international| unported)?
  1 alike: creative commons attribution share alike(?: [1-4] [05])?(?: international| unported)?
  0 sa: creativecommons org licenses by sa(?: [1-4] [05])?
cc-by
  4 spdx: spdx license identifier cc by [1-4] [05]
  2 cc: cc by [1-4] [05]
  1 creative: creative commons attribution(?: [1-4] [05])?(?: international| unported)?
  0 by: creativecommons org licenses by(?: [1-4] [05])?
cc
  1 creative: (?:a )?creative commons licen[cs]e
  1 creative: licen[cs]e creative commons
  1 licencia: licencia (?:de )?creative commons
  1 lizenz: creative commons lizenz
odbl
  4 spdx: spdx license identifier odbl 1 0
  1 database: open (?:data commons open )?database licen[cs]e
  1 odbl: odbl
odc-by
  4 spdx: spdx license identifier odc by 1 0
  1 commons: open data commons attribution licen[cs]e
pddl
  4 spdx: spdx license identifier pddl 1 0
  1 commons: open data commons public domain dedication(?: and licen[cs]e)?
ofl-1.1
  4 spdx: spdx license identifier ofl 1 1
  3 sil: this font software is licensed under the sil open font licen[cs]e
  1 sil: sil open font licen[cs]e(?: (?:version )?1 1)?
ofl-1
  4 spdx: spdx license identifier ofl 1 0
  1 sil: sil open font licen[cs]e (?:version )?1 0
eupl-1.2
  4 spdx: spdx license identifier eupl 1 2
  2 european: european union public licen[cs]e (?:version |v ?)?1 2
  2 eupl: eupl (?:version |v ?)?1 2
eupl
  4 spdx: spdx license identifier eupl 1 [01]
  1 european: european union public licen[cs]e
  1 eupl: eupl
osl-3
  4 spdx: spdx license identifier osl [123] [01]
  1 open: open software licen[cs]e(?: (?:version |v ?)?3 0)?
afl-3
  4 spdx: spdx license identifier afl [123] [0-2]
  1 academic: academic free licen[cs]e(?: (?:version |v ?)?[123] [0-2])?
ecl-2
  4 spdx: spdx license identifier ecl 2 0
  1 educational: educational community licen[cs]e(?: (?:version )?2 0)?
ms-pl
  4 spdx: spdx license identifier ms pl
  1 microsoft: microsoft public licen[cs]e
ms-rl
  4 spdx: spdx license identifier ms rl
  1 reciprocal: microsoft reciprocal licen[cs]e
psf-2
  4 spdx: spdx license identifier (?:psf|python) 2 0
  1 python: python software foundation licen[cs]e
  1 psf: psf licen[cs]e
php-3
  4 spdx: spdx license identifier php 3 01?
  1 php: php licen[cs]e(?: (?:version )?3 01?)?
ruby
  4 spdx: spdx license identifier ruby
  1 ruby: ruby licen[cs]e
openssl
  4 spdx: spdx license identifier openssl
  1 openssl: openssl licen[cs]e
  5 openssl: this product includes software developed by the openssl project
curl
  4 spdx: spdx license identifier curl
w3c
  4 spdx: spdx license identifier w3c(?: 20150513)?
  1 w3c: w3c software (?:and document )?(?:notice and )?licen[cs]e
postgresql
  4 spdx: spdx license identifier postgresql
  1 postgresql: postgresql licen[cs]e
ncsa
  4 spdx: spdx license identifier ncsa
  1 ncsa: (?:university of illinois )?ncsa open source licen[cs]e
unicode
  4 spdx: spdx license identifier unicode (?:dfs 2016|3 0|tou)
  1 unicode: unicode licen[cs]e (?:agreement|v3)
blueoak-1
  4 spdx: spdx license identifier blueoak 1 0 0
  1 blue: blue oak model licen[cs]e(?: 1 0 0)?
cecill
  4 spdx: spdx license identifier cecill (?:1 [01]|2 [01]|b|c)
  1 cecill: (?:licence |license )?cecill(?: (?:b|c|v?2(?: 1)?))?
sspl-1
  4 spdx: spdx license identifier sspl 1 0
  1 side: server side public licen[cs]e
elastic-2
  4 spdx: spdx license identifier elastic 2 0
  1 elastic: elastic licen[cs]e(?: (?:version )?2(?: 0)?)?
polyform
  4 spdx: spdx license identifier polyform (?:noncommercial|small business) 1 0 0
  1 polyform: polyform (?:noncommercial|small business|shield|strict) licen[cs]e
openrail
  1 openrail: (?:creativeml |bigscience |bigcode )?openrail(?: m)?(?: licen[cs]e)?
  1 rail: (?:bigscience|bigcode|responsible ai) rail licen[cs]e
hippocratic
  4 spdx: spdx license identifier hippocratic 2 1
  1 hippocratic: hippocratic licen[cs]e
upl-1
  4 spdx: spdx license identifier upl 1 0
  1 permissive: universal permissive licen[cs]e
qpl-1
  4 spdx: spdx license identifier qpl 1 0
  1 q: q public licen[cs]e
mulan-2
  4 spdx: spdx license identifier mulanpsl 2 0
  1 mulan: mulan p(?:ermissive )?s(?:oftware )?l(?:icen[cs]e)?(?: v(?:ersion )?2)?
public-domain
  3 domain: (?:released|placed|dedicated|donated) (?:\S+ )?(?:in|into|to) the public domain
  3 domain: (?:is|are) in the public domain
all-rights-reserved
  3 rights: all rights reserved
  3 droits: tous droits réservés
  3 rechte: alle rechte vorbehalten
  3 derechos: todos los derechos reservados
proprietary
  5 proprietary: this (?:software|document|file) is (?:the )?(?:confidential and )?proprietary (?:and confidential )?(?:information|property) of
  3 proprietary: proprietary and confidential
  3 unauthorized: unauthorized (?:copying|reproduction|distribution) of this (?:file|document|software)( \S+){0,6} is (?:strictly )?prohibited
"""
