"""The license rules, in their order of priority.

A line has the confidence, the label, the keyword that every match holds, and the pattern, over lower-cased words with
single spaces. Identifiers come first, then the sentences that licenses ask for, then texts of their own, then
addresses, then names with a version, then names alone, and what only restricts use comes last.
"""

RULES = r"""
0.99 | apache | spdx license identifier apache | spdx license identifier apache (?:1 [01]|2 0)
0.99 | mit-0 | spdx license identifier mit 0 | spdx license identifier mit 0
0.99 | mit | spdx license identifier mit | spdx license identifier mit
0.99 | bsd | spdx license identifier bsd | spdx license identifier bsd [1-4] clause(?: clear| patent)?
0.99 | bsd | spdx license identifier 0bsd | spdx license identifier 0bsd
0.99 | agpl | spdx license identifier agpl | spdx license identifier agpl [13] 0(?: only| or later)?
0.99 | lgpl | spdx license identifier lgpl | spdx license identifier lgpl (?:2 [01]|3 0)(?: only| or later)?
0.99 | gpl | spdx license identifier gpl | spdx license identifier gpl [123] 0(?: only| or later)?
0.99 | gfdl | spdx license identifier gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
0.99 | mpl | spdx license identifier mpl | spdx license identifier mpl (?:1 [01]|2 0)
0.99 | epl | spdx license identifier epl | spdx license identifier epl [12] 0
0.99 | cddl | spdx license identifier cddl | spdx license identifier cddl 1 [01]
0.99 | eupl | spdx license identifier eupl | spdx license identifier eupl 1 [012]
0.99 | isc | spdx license identifier isc | spdx license identifier isc
0.99 | zlib | spdx license identifier zlib | spdx license identifier zlib
0.99 | unlicense | spdx license identifier unlicense | spdx license identifier unlicense
0.99 | boost | spdx license identifier bsl | spdx license identifier bsl 1 0
0.99 | python | spdx license identifier psf | spdx license identifier psf 2 0
0.99 | python | spdx license identifier python | spdx license identifier python 2 0
0.99 | artistic | spdx license identifier artistic | spdx license identifier artistic [12] 0
0.99 | wtfpl | spdx license identifier wtfpl | spdx license identifier wtfpl
0.99 | ofl | spdx license identifier ofl | spdx license identifier ofl 1 [01]
0.99 | postgresql | spdx license identifier postgresql | spdx license identifier postgresql
0.99 | openssl | spdx license identifier openssl | spdx license identifier openssl
0.99 | ncsa | spdx license identifier ncsa | spdx license identifier ncsa
0.99 | ms-pl | spdx license identifier ms pl | spdx license identifier ms pl
0.99 | ms-rl | spdx license identifier ms rl | spdx license identifier ms rl
0.99 | odbl | spdx license identifier odbl | spdx license identifier odbl 1 0
0.99 | cc0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
0.99 | cc-by-nc-sa | spdx license identifier cc by nc sa | spdx license identifier cc by nc sa [1-4] [05]
0.99 | cc-by-nc-nd | spdx license identifier cc by nc nd | spdx license identifier cc by nc nd [1-4] [05]
0.99 | cc-by-nc | spdx license identifier cc by nc | spdx license identifier cc by nc [1-4] [05]
0.99 | cc-by-nd | spdx license identifier cc by nd | spdx license identifier cc by nd [1-4] [05]
0.99 | cc-by-sa | spdx license identifier cc by sa | spdx license identifier cc by sa [1-4] [05]
0.99 | cc-by | spdx license identifier cc by | spdx license identifier cc by [1-4] [05]
0.98 | agpl | affero | under the terms of the gnu affero general public licen[cs]e(?: as published by the free software foundation)?
0.98 | lgpl | under the terms of the gnu | under the terms of the gnu (?:lesser|library) general public licen[cs]e(?: as published by the free software foundation)?
0.98 | gpl | under the terms of the gnu | under the terms of the gnu general public licen[cs]e(?: as published by the free software foundation)?
0.95 | gpl | received a copy of the gnu | received a copy of the gnu general public licen[cs]e along with this (?:program|library|software)
0.95 | lgpl | received a copy of the gnu | received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:program|library|software)
0.95 | agpl | received a copy of the gnu | received a copy of the gnu affero general public licen[cs]e along with this (?:program|library|software)
0.8 | gpl-or-later | at your option | either version [123] of the licen[cs]e or at your option any later version
0.98 | apache | licensed under the apache | licensed under the apache licen[cs]e version (?:1 [01]|2 0)(?: the licen[cs]e)?
0.9 | apache | limitations under the license | see the license for the specific language governing permissions and limitations under the license
0.9 | apache | except in compliance with the license | you may not use this file except in compliance with the license
0.98 | mpl | subject to the terms of the mozilla | subject to the terms of the mozilla public licen[cs]e v (?:1 [01]|2 0)
0.95 | mpl | contents of this file are subject to the mozilla | contents of this file are subject to the mozilla public licen[cs]e version (?:1 [01]|2 0)
0.9 | mpl | incompatible with secondary licenses | incompatible with secondary licenses
0.95 | epl | made available under the terms of the eclipse | made available under the terms of the eclipse public licen[cs]e v(?:ersion)? ?[12] 0
0.95 | cddl | subject to the terms of the common development | subject to the terms of the common development and distribution licen[cs]e
0.95 | eupl | licensed under the eupl | licensed under the eupl(?: version)? 1 [012](?: or as soon)?
0.95 | artistic | terms of the artistic | (?:under|subject to) the terms of the artistic licen[cs]e
0.95 | perl | same terms as perl | (?:redistribute|licensed)(?: it)?(?: and or modify it)? under the same terms as perl(?: itself)?
0.98 | mit | permission is hereby granted free of charge | permission is hereby granted free of charge to any person obtaining a copy
0.95 | mit | substantial portions of the software | shall be included in all copies or substantial portions of the software
0.9 | mit | in an action of contract | whether in an action of contract tort or otherwise arising from
0.95 | bsd | source and binary forms | redistributions? and use in source and binary forms with or without modification
0.9 | bsd | redistributions of source code must retain | redistributions of source code must retain the above copyright notice
0.9 | bsd | redistributions in binary form must reproduce | redistributions in binary form must reproduce the above copyright notice
0.95 | bsd-3-clause | endorse or promote products | used to endorse or promote products derived from this software
0.95 | bsd-4-clause | advertising materials mentioning features | all advertising materials mentioning features or use of this software
0.9 | bsd | and contributors as is | provided by the copyright holders and contributors as is
0.95 | isc | permission to use copy modify | permission to use copy modify and(?: or)? distribute this software for any purpose
0.9 | isc | the author disclaims all warranties | the author disclaims all warranties with regard to this software
0.95 | zlib | as is without any express or implied | provided as is without any express or implied warranty
0.9 | zlib | altered source versions must be plainly marked | altered source versions must be plainly marked as such
0.9 | zlib | origin of this software must not be misrepresented | origin of this software must not be misrepresented
0.98 | unlicense | free and unencumbered software | free and unencumbered software released into the public domain
0.95 | boost | any person or organization obtaining a copy | permission is hereby granted free of charge to any person or organization obtaining a copy
0.95 | wtfpl | do what the fuck you want to | do what the fuck you want to public licen[cs]e
0.95 | openssl | use in the openssl toolkit | developed by the openssl project for use in the openssl toolkit
0.95 | ofl | font software is licensed under | (?:this )?font software is licensed under the sil open font licen[cs]e
0.9 | ofl | reserved font name | with reserved font names?
0.95 | postgresql | without a written agreement | copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement
0.95 | ncsa | university of illinois | university of illinois (?:ncsa )?open source licen[cs]e
0.95 | python | python software foundation license | python software foundation license(?: version)?(?: 2)?
0.95 | json | used for good not evil | the software shall be used for good not evil
0.9 | beerware | buy me a beer | you can buy me a beer in return
0.95 | w3c | w3c software notice | w3c software notice and license
0.95 | icu | icu license | icu license(?: icu 1 8 1 and later)?
0.95 | curl | curl license | curl license
0.95 | libpng | png reference library license | png reference library license(?: version 2)?
0.95 | ijg | independent jpeg group | based in part on the work of the independent jpeg group
0.95 | freetype | freetype project license | (?:the )?freetype project license
0.95 | php | php license | php license(?: version)?(?: 3 0(?: 1)?)?
0.95 | ruby | ruby license | (?:under|terms of) the ruby license
0.95 | vim | vim license | vim license
0.95 | tcl | tcl tk license | tcl tk license
0.95 | x11 | x11 licen | x11 licen[cs]e
0.95 | expat | expat license | expat license
0.95 | ms-pl | microsoft public license | microsoft public license(?: ms pl)?
0.95 | ms-rl | microsoft reciprocal license | microsoft reciprocal license(?: ms rl)?
0.95 | sspl | server side public license | server side public license(?: v(?:ersion)? ?1)?
0.95 | busl | business source license | business source license(?: 1 1)?
0.95 | elastic | elastic license | elastic license(?: 2 0| v2)?
0.95 | polyform | polyform | polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) licen[cs]e
0.95 | rail | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: [a-z])? licen[cs]e
0.95 | rail | responsible ai license | responsible ai license
0.95 | llama | community license agreement | llama (?:[23] )?(?:[0-9] )?community license agreement
0.95 | gemma | gemma terms of use | (?:subject to|under) the gemma terms of use and license
0.95 | ecl | educational community license | educational community license(?: version)?(?: 2 0)?
0.95 | afl | academic free license | academic free license(?: version| v)? ?(?:[123] [01])?
0.95 | osl | open software license | open software license(?: version| v)? ?(?:[123] [01])?
0.95 | cpl | common public license | common public license(?: version| v)? ?(?:1 0)?
0.95 | cpal | common public attribution license | common public attribution license(?: version)?(?: 1 0)?
0.95 | ipl | ibm public license | ibm public license(?: version)?(?: 1 0)?
0.95 | qpl | q public license | q public license(?: version)?(?: 1 0)?
0.95 | npl | netscape public license | netscape public license(?: version)?(?: 1 [01])?
0.95 | spl | sun public license | sun public license(?: version)?(?: 1 0)?
0.95 | apsl | apple public source license | apple public source license(?: version)?(?: [12] [012])?
0.95 | rpl | reciprocal public license | reciprocal public license(?: version)?(?: 1 [15])?
0.95 | lppl | latex project public license | latex project public license(?: version)?(?: 1 [0123])?
0.95 | cecill | cecill | cecill(?: [abc])?(?: v ?[12](?: [01])?)? licen[cs]e
0.95 | mulan | mulan psl | mulan psl v ?[12] license
0.95 | upl | universal permissive license | universal permissive license(?: v 1 0)?
0.95 | blueoak | blue oak model license | blue oak model license(?: 1 0 0)?
0.95 | ogl | open government licen | open government licen[cs]e(?: v(?:ersion)? ?[123] 0)?
0.95 | ogl | contains public sector information | contains public sector information licensed under
0.95 | opl | open publication license | open publication license(?: v(?:ersion)? ?1 0)?
0.95 | fal | free art license | free art license(?: 1 [123])?
0.95 | odc-by | open data commons attribution license | open data commons attribution license(?: v1 0)?
0.95 | pddl | public domain dedication and license | (?:open data commons )?public domain dedication and license
0.95 | odbl | open database licen | open database licen[cs]e(?: odbl)?(?: v(?:ersion)? ?1 0)?
0.95 | cdla | community data license agreement | community data license agreement(?: (?:permissive|sharing))?(?: version)?(?: [12] 0)?
0.95 | apache | apache org licenses | apache org licenses(?: license (?:1 [01]|2 0))?
0.95 | agpl | gnu org licenses agpl | gnu org licenses agpl(?: 3 0)?
0.95 | lgpl | gnu org licenses | gnu org licenses (?:old licenses )?lgpl(?: [23] [01])?
0.95 | gfdl | gnu org licenses fdl | gnu org licenses fdl(?: 1 [123])?
0.95 | gpl | gnu org licenses | gnu org licenses (?:old licenses )?gpl(?: [123] 0)?
0.95 | mpl | mozilla org mpl | mozilla org mpl(?: (?:1 [01]|2 0))?
0.95 | epl | eclipse org legal epl | eclipse org legal epl v[12]0
0.95 | mit | opensource org licenses mit | opensource org licenses mit(?: licen[cs]e)?
0.95 | bsd | opensource org licenses bsd | opensource org licenses bsd(?: [1-4] clause| licen[cs]e)?
0.95 | isc | opensource org licenses isc | opensource org licenses isc
0.95 | artistic | opensource org licenses artistic | opensource org licenses artistic licen[cs]e
0.9 | osi | opensource org licenses | opensource org licenses
0.95 | unlicense | unlicense org | unlicense org licen[cs]e
0.95 | boost | boost org license | boost org license 1 0
0.95 | ofl | scripts sil org ofl | licen[cs]e (?:with a faq )?(?:is )?available (?:with a faq )?at (?:https? )?scripts sil org ofl
0.95 | cc0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero(?: 1 0)?
0.95 | public-domain | creativecommons org publicdomain mark | creativecommons org publicdomain mark(?: 1 0)?
0.95 | cc-by-nc-sa | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa(?: [1-4] [05])?
0.95 | cc-by-nc-nd | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd(?: [1-4] [05])?
0.95 | cc-by-nc | creativecommons org licenses by nc | creativecommons org licenses by nc(?: [1-4] [05])?
0.95 | cc-by-nd | creativecommons org licenses by nd | creativecommons org licenses by nd(?: [1-4] [05])?
0.95 | cc-by-sa | creativecommons org licenses by sa | creativecommons org licenses by sa(?: [1-4] [05])?
0.95 | cc-by | creativecommons org licenses by | creativecommons org licenses by(?: [1-4] [05])?
0.9 | cc | creativecommons org | creativecommons org (?:licenses|publicdomain)
0.95 | cc-by-nc-sa | cc by nc sa | (?:licensed under )?cc by nc sa(?: [1-4] [05])?
0.95 | cc-by-nc-nd | cc by nc nd | (?:licensed under )?cc by nc nd(?: [1-4] [05])?
0.95 | cc-by-nc | cc by nc | (?:licensed under )?cc by nc(?: [1-4] [05])?
0.95 | cc-by-nd | cc by nd | (?:licensed under )?cc by nd(?: [1-4] [05])?
0.95 | cc-by-sa | cc by sa | (?:licensed under )?cc by sa(?: [1-4] [05])?
0.95 | cc-by | cc by | (?:licensed under )?cc by [1-4] [05]
0.95 | cc-by-nc-sa | creative commons attribution non | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
0.95 | cc-by-nc-nd | creative commons attribution non | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: [1-4] [05])?
0.95 | cc-by-nc | creative commons attribution non | creative commons attribution non ?commercial(?: [1-4] [05])?
0.95 | cc-by-nd | creative commons attribution no | creative commons attribution no ?deriv(?:ative)?s?(?: [1-4] [05])?
0.95 | cc-by-sa | creative commons attribution share | creative commons attribution share ?alike(?: [1-4] [05])?
0.95 | cc-by | creative commons attribution | creative commons attribution(?: [1-4] [05]| licen[cs]e)
0.95 | cc0 | cc0 | cc0(?: 1 0)?(?: universal| public domain dedication| licen[cs]e)
0.9 | cc0 | cc0 | cc0 1 0
0.9 | cc0 | creative commons zero | creative commons zero(?: 1 0)?(?: v1 0)?
0.85 | cc | creative commons | (?:under|by|through) an? creative commons licen[cs]e
0.9 | agpl | gnu affero general public license | gnu affero general public license(?: version| v)? ?(?:[13](?: 0)?)?
0.9 | lgpl | general public license | gnu (?:lesser|library) general public license(?: version| v)? ?(?:2 1|[23](?: 0)?)?
0.9 | gpl | gnu general public license | gnu general public license(?: version| v)? ?(?:[123](?: 0)?)?
0.9 | gfdl | gnu free documentation license | gnu free documentation license(?: version| v)? ?(?:1 [123])?
0.9 | agpl | agpl | agpl ?v?3(?: 0)?(?: only| or later)?
0.9 | lgpl | lgpl | lgpl ?v?(?:2 [01]|[23](?: 0)?)(?: only| or later)?
0.9 | gpl | gpl | gpl ?v?[23](?: 0)?(?: only| or later)?
0.85 | gpl | gnu gpl | gnu gpl
0.85 | lgpl | gnu lgpl | gnu lgpl
0.85 | agpl | gnu agpl | gnu agpl
0.85 | gfdl | gnu fdl | gnu fdl
0.9 | apache | apache | apache(?: software)? licen[cs]e(?: version| v)? ?(?:1 [01]|2(?: 0)?)?
0.85 | apache | apache 2 0 | (?:licensed|released|distributed|available|published) under (?:the )?apache 2 0
0.9 | mit-0 | mit no attribution | mit no attribution(?: licen[cs]e)?
0.85 | mit | under | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?mit(?: licen[cs]e)?
0.8 | mit | mit licen | mit licen[cs]e
0.85 | bsd | clause bsd | [1-4] clause bsd(?: licen[cs]e)?
0.85 | bsd | bsd | bsd [1-4] clause(?: licen[cs]e)?
0.85 | bsd | under | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the |a )?bsd(?: style)?(?: licen[cs]e)?
0.8 | bsd | bsd | (?:new |modified |simplified |original )?bsd(?: style)? licen[cs]e
0.85 | isc | isc licen | (?:the )?isc licen[cs]e
0.85 | mpl | mozilla public licen | mozilla public licen[cs]e(?: version| v)? ?(?:1 [01]|2 0)?
0.8 | mpl | mpl | mpl (?:1 [01]|2 0)
0.85 | epl | eclipse public licen | eclipse public licen[cs]e(?: version| v)? ?(?:[12] 0)?
0.8 | epl | epl | epl [12] 0
0.85 | cddl | common development and distribution licen | common development and distribution licen[cs]e(?: version)?(?: 1 [01])?
0.8 | cddl | cddl | cddl 1 [01]
0.85 | eupl | european union public licen | european union public licen[cs]e(?: version)?(?: 1 [012])?
0.8 | eupl | eupl | eupl (?:v ?)?1 [012]
0.85 | artistic | artistic licen | (?:perl )?artistic licen[cs]e(?: version)?(?: [12] 0)?
0.85 | zlib | zlib | zlib(?: libpng)? licen[cs]e
0.85 | boost | boost software licen | boost software licen[cs]e(?: version)?(?: 1 0)?
0.85 | python | psf licen | psf licen[cs]e(?: agreement)?
0.85 | wtfpl | wtfpl | wtfpl(?: v(?:ersion)? ?[12])?
0.85 | ofl | open font licen | (?:sil )?open font licen[cs]e(?: version)?(?: 1 [01])?
0.8 | ofl | ofl | ofl 1 [01]
0.85 | postgresql | postgresql licen | postgresql licen[cs]e
0.85 | openssl | openssl licen | (?:dual )?openssl licen[cs]e
0.85 | unlicense | unlicense | (?:under|by) the unlicense
0.8 | gfdl | gfdl | gfdl(?: 1 [123])?
0.8 | odbl | odbl | odbl(?: (?:v ?)?1 0)?
0.9 | public-domain | public domain | (?:released|placed|dedicated|is) (?:in|into|to) the public domain
0.8 | public-domain | in the public domain | work is in the public domain
0.8 | dual | dual licensed under | dual licensed under
0.8 | no-warranty | without warranty | (?:provided|distributed) (?:as is )?without warranty
0.8 | no-warranty | without even the implied warranty | without even the implied warranty of merchantability
0.8 | no-warranty | as is basis | distributed on an as is basis without warranties
0.8 | reserved | all rights reserved | all rights reserved
0.8 | reserved | some rights reserved | some rights reserved
0.8 | proprietary | proprietary and confidential | proprietary and confidential
0.8 | proprietary | confidential and proprietary | confidential and proprietary
0.8 | proprietary | may not be | may not be (?:copied|reproduced|distributed|used) without (?:prior |written |express )*permission
0.8 | proprietary | unauthorized | unauthorized (?:copying|reproduction|distribution|use) of (?:this|the) (?:file|software|document|material) is (?:strictly )?prohibited (?:via any medium )?(?:proprietary|without permission)
0.8 | proprietary | end user license agreement | end user license agreement
0.8 | proprietary | is licensed not sold | (?:software|product) is licensed not sold
0.8 | non-commercial | non commercial use only | licen[cs]ed for non commercial use only
0.8 | non-commercial | noncommercial use only | licen[cs]ed for noncommercial use only
0.8 | non-commercial | commercial use is prohibited | commercial use is prohibited (?:without )permission
0.8 | research-only | research purposes only | licen[cs]ed for (?:academic )?research purposes only
0.8 | copyright | copyright | copyright (?:c )?(?:19|20)[0-9]{2}
"""
