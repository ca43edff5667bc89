"""Signatures of licenses, written by hand: grants, headers, notices, clauses and ways to cite, the most specific first in a family.

Each is (label, priority, keyword, pattern) over a text's lower-case words one space apart, so a pattern knows no punctuation: 2.0 is
"2 0" and l'acte is "l acte". Every match of a pattern contains its keyword, so texts without it need not be searched.
"""

from __future__ import annotations

#: Priorities: a license's own text, a notice that grants it, an identifier, a name with a version, a mere name, a mere abbreviation.
TEXT, NOTICE, TAG, VERSION, NAME, SHORT = 95, 85, 90, 70, 40, 30

SIGNATURES: list[tuple[str, int, str, str]] = [
    # GNU
    ("gpl-3-or-later", NOTICE, "gnu general public", r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2-or-later", NOTICE, "gnu general public", r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-1-or-later", NOTICE, "gnu general public", r"under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version"),
    ("gpl-2", NOTICE, "gnu general public", r"under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl-3", NOTICE, "gnu general public", r"under the terms of the gnu general public license version 3 (?:only )?as published by the free software foundation"),
    ("gpl-2", NOTICE, "gnu general public", r"licensed under the (?:terms of the )?gnu general public license version 2"),
    ("gpl-3", NOTICE, "gnu general public", r"licensed under the (?:terms of the )?gnu general public license version 3"),
    ("gpl-3", TEXT, "gnu general public", r"gnu general public license version 3 29 june 2007"),
    ("gpl-2", TEXT, "gnu general public", r"gnu general public license version 2 june 1991"),
    ("gpl-1", TEXT, "gnu general public", r"gnu general public license version 1 february 1989"),
    ("gpl", TEXT, "share and change", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", TEXT, "free copyleft", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl", NOTICE, "gnu general public", r"you should have received a copy of the gnu general public license along with this (?:program|file|software|library)"),
    ("gpl-classpath", NOTICE, "classpath", r"as a special exception .{0,200}classpath exception|with (?:the )?classpath exception|gpl (?:v2 |2 0 |version 2 )?(?:with|w) (?:the )?classpath"),
    ("gpl-font", NOTICE, "font exception", r"with (?:the )?font exception"),
    ("gpl-bison", NOTICE, "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("lgpl-3-or-later", NOTICE, "lesser general public", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", NOTICE, "lesser general public", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-2-or-later", NOTICE, "library general public", r"under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl-2.1", TEXT, "lesser general public", r"gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-3", TEXT, "lesser general public", r"gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2", TEXT, "library general public", r"gnu library general public license version 2 june 1991"),
    ("lgpl", NOTICE, "lesser general public", r"you should have received a copy of the gnu lesser general public license"),
    ("lgpl", NOTICE, "library general public", r"you should have received a copy of the gnu library general public license"),
    ("agpl-3-or-later", NOTICE, "affero general public", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3", TEXT, "affero general public", r"gnu affero general public license version 3 19 november 2007"),
    ("agpl-1", TEXT, "affero general public", r"affero general public license version 1 march 2002"),
    ("agpl", NOTICE, "affero general public", r"you should have received a copy of the gnu affero general public license"),
    ("gfdl-1.3", NOTICE, "free documentation", r"under the terms of the gnu free documentation license version 1 3 or any later version published by the free software foundation"),
    ("gfdl-1.2", NOTICE, "free documentation", r"under the terms of the gnu free documentation license version 1 2 or any later version published by the free software foundation"),
    ("gfdl-1.1", NOTICE, "free documentation", r"under the terms of the gnu free documentation license version 1 1 or any later version published by the free software foundation"),
    ("gfdl", NOTICE, "invariant sections", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gnu-all-permissive", NOTICE, "with or without modification", r"copying and distribution of this file with or without modification are permitted in any medium without royalty"),
    # MIT and its kin
    ("mit", TEXT, "permission is hereby granted free of charge", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", TEXT, "shall be included in all copies", r"the above copyright notice and this permission notice(?: including the next paragraph)? shall be included in all copies or substantial portions of the software"),
    ("mit", NOTICE, "mit licen", r"(?:released|licensed|distributed|available|published|provided|covered) under (?:the )?(?:terms of the )?mit licen[cs]e"),
    ("mit", NOTICE, "mit licen", r"use of this source code is governed by an? mit(?: style)? licen[cs]e"),
    ("mit", NAME, "the mit licen", r"the mit licen[cs]e(?: mit)?"),
    ("mit-0", NAME, "mit no attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("mit-x11", NAME, "x11 licen", r"(?:mit )?x11 licen[cs]e"),
    ("x11", TEXT, "x consortium", r"except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("isc", TEXT, "and or distribute this software for any purpose", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", TEXT, "and distribute this software for any purpose", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", TEXT, "for any purpose with or without fee is hereby granted", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)"),
    ("hpnd", TEXT, "in supporting documentation", r"provided that the above copyright notice appear in all copies and that both that copyright notice and this permission notice appear in supporting documentation"),
    ("isc", NOTICE, "isc licen", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?isc licen[cs]e"),
    ("zlib", TEXT, "for any purpose including commercial applications", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", TEXT, "origin of this software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("bsl-1", TEXT, "accompanying documentation covered by this license", r"to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("bsl-1", NOTICE, "boost software licen", r"distributed under the boost software licen[cs]e version 1 0"),
    ("curl", TEXT, "in advertising or otherwise to promote", r"shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("ntp", TEXT, "makes no representations about the suitability", r"makes no representations about the suitability this software for any purpose it is provided as is without express or implied warranty"),
    ("unlicense", TEXT, "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", NOTICE, "unlicense org", r"for more information please refer to (?:https? )?(?:www )?unlicense org"),
    ("public-domain", NOTICE, "public domain", r"(?:is|are|been|hereby) (?:hereby )?(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", NOTICE, "disclaims copyright", r"the author disclaims copyright to this source code"),
    ("wtfpl-2", TEXT, "do what the fuck", r"do what the fuck you want to public license version 2 december 2004"),
    ("wtfpl", TEXT, "do what the fuck", r"0 you just do what the fuck you want to"),
    ("beerware", TEXT, "beer ware licen", r"the beer ware licen[cs]e"),
    ("beerware", TEXT, "buy me a beer", r"if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", TEXT, "for good not evil", r"the software shall be used for good not evil"),
    # BSD
    ("bsd", TEXT, "redistribution and use in source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", TEXT, "redistributions of source code", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", TEXT, "redistributions in binary form", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", TEXT, "endorse or promote products", r"neither the names? of .{1,120}? nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-3-clause", TEXT, "endorse or promote products", r"the names? of the authors? may not be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", TEXT, "all advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-3-clause", NOTICE, "bsd style licen", r"use of this source code is governed by a bsd style licen[cs]e that can be found in the license file"),
    ("bsd", NOTICE, "bsd", r"(?:released|licensed|distributed|available|provided) under (?:the )?(?:terms of the )?(?:new |modified |simplified |revised |freebsd |[234] clause )?bsd(?: style)? licen[cs]e"),
    ("bsd-3-clause-clear", TEXT, "no express or implied licenses", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-patent", NAME, "plus patent", r"bsd 2 clause plus patent(?: licen[cs]e)?"),
    ("bsd-2-clause", VERSION, "simplified bsd", r"simplified bsd licen[cs]e"),
    ("bsd-2-clause", VERSION, "freebsd licen", r"freebsd licen[cs]e"),
    ("bsd-3-clause", VERSION, "bsd", r"(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-4-clause", VERSION, "bsd", r"(?:original|old) bsd licen[cs]e"),
    # Apache
    ("apache-2", TEXT, "apache license version 2 0 january", r"apache license version 2 0 january 2004"),
    ("apache-2", NOTICE, "licensed under the apache license", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", NOTICE, "licensed to the apache software foundation", r"licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-2", NOTICE, "apache org licenses license 2 0", r"(?:https? )?(?:www )?apache org licenses license 2 0(?: html| txt)?"),
    ("apache-2", NOTICE, "apache", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of the )?apache(?: software)? licen[cs]e(?: version)? 2(?: 0)?"),
    ("apache-1.1", TEXT, "includes software developed by the apache", r"this product includes software developed by the apache software foundation"),
    ("apache-1", TEXT, "developed by the apache group", r"this product includes software developed by the apache group for use in the apache http server project"),
    ("apache", NAME, "asl", r"apache (?:software licen[cs]e )?asl(?: 2 0)?"),
    # Mozilla, Eclipse, Sun, IBM
    ("mpl-2", NOTICE, "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl-2", TEXT, "mozilla public license version 2 0", r"mozilla public license version 2 0 1 definitions"),
    ("mpl-1.1", NOTICE, "mozilla public licen", r"subject to the mozilla public licen[cs]e version 1 1"),
    ("mpl-1", NOTICE, "mozilla public licen", r"subject to the mozilla public licen[cs]e version 1 0"),
    ("mpl-2", NOTICE, "mozilla org mpl 2 0", r"mozilla org mpl 2 0"),
    ("npl-1.1", NAME, "netscape public licen", r"netscape public licen[cs]e(?: version)? 1 1"),
    ("npl", NAME, "netscape public licen", r"netscape public licen[cs]e"),
    ("epl-2", NOTICE, "eclipse public licen", r"made available under the terms of the eclipse public licen[cs]e 2 0"),
    ("epl-2", NOTICE, "eclipse public licen", r"made available under the terms of the eclipse public licen[cs]e v 2 0"),
    ("epl-1", NOTICE, "eclipse public licen", r"made available under the terms of the eclipse public licen[cs]e v1 0"),
    ("edl-1", NAME, "eclipse distribution licen", r"eclipse distribution licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("cddl-1", NOTICE, "common development and distribution licen", r"subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl-1", TEXT, "common development and distribution licen", r"common development and distribution licen[cs]e cddl version 1 0"),
    ("cpl-1", NOTICE, "common public licen", r"made available under the terms of the common public licen[cs]e v1 0"),
    ("ipl-1", NAME, "ibm public licen", r"ibm public licen[cs]e(?: version| v)? 1(?: 0)?"),
    ("sissl", NAME, "sun industry standards source licen", r"sun industry standards source licen[cs]e"),
    ("spl-1", NAME, "sun public licen", r"sun public licen[cs]e(?: version)? 1 0"),
    ("qpl-1", NAME, "q public licen", r"q public licen[cs]e(?: version)?(?: 1 0)?"),
    ("apsl-2", NAME, "apple public source licen", r"apple public source licen[cs]e(?: version)? 2 0"),
    ("apsl", NAME, "apple public source licen", r"apple public source licen[cs]e"),
    ("rpl-1.5", NAME, "reciprocal public licen", r"reciprocal public licen[cs]e(?: version)?(?: 1 5)?"),
    ("sleepycat", NAME, "sleepycat", r"sleepycat(?: public)? licen[cs]e"),
    ("watcom-1", NAME, "open watcom public licen", r"(?:sybase )?open watcom public licen[cs]e"),
    ("intel", NAME, "intel open source licen", r"intel open source licen[cs]e"),
    ("nosl", NAME, "netizen open source licen", r"netizen open source licen[cs]e"),
    ("nasa-1.3", NAME, "nasa open source agreement", r"nasa open source agreement(?: version)?(?: 1 3)?"),
    ("cpal-1", NAME, "common public attribution licen", r"common public attribution licen[cs]e(?: version)?(?: 1 0)?"),
    ("vsl-1", NAME, "vovida software licen", r"vovida software licen[cs]e(?: v)?(?: 1 0)?"),
    ("w3c", TEXT, "w3c software", r"w3c software (?:notice and license|and document notice and license)"),
    ("w3c", NAME, "w3c licen", r"w3c licen[cs]e"),
    ("ofl-1.1", NOTICE, "sil open font licen", r"this font software is licensed under the sil open font licen[cs]e version 1 1"),
    ("ofl-1.1", TEXT, "sil open font licen", r"sil open font licen[cs]e version 1 1 26 february 2007"),
    ("artistic-2", TEXT, "artistic license 2 0", r"the artistic license 2 0 copyright c 2000 2006 the perl foundation"),
    ("artistic-1", TEXT, "intent of this document is to state the conditions", r"the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-or-gpl", NOTICE, "same terms as perl", r"under the same terms as perl(?: 5)?(?: itself)?"),
    ("psf-2", TEXT, "python software foundation license version 2", r"python software foundation license version 2"),
    ("python-cnri", NAME, "cnri python licen", r"cnri python licen[cs]e"),
    ("ruby", NOTICE, "same terms as ruby", r"under the same terms as ruby(?: itself)?"),
    ("ruby", NAME, "ruby licen", r"ruby licen[cs]e"),
    ("php-3.01", TEXT, "php licen", r"the php licen[cs]e version 3 01"),
    ("openssl", TEXT, "openssl project", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("openssl", NAME, "openssl licen", r"openssl licen[cs]e"),
    ("ssleay", TEXT, "written by eric young", r"this product includes cryptographic software written by eric young"),
    ("libpng", TEXT, "png reference library", r"permission is hereby granted to use copy modify and distribute this source code or portions hereof for any purpose .{0,120}png reference library|png reference library license"),
    ("libtiff", TEXT, "sam leffler", r"the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("ijg", TEXT, "independent jpeg group", r"this software is based in part on the work of the independent jpeg group"),
    ("freetype", TEXT, "freetype project", r"portions of this software are copyright .{0,40}the freetype project|the freetype project license"),
    ("icu", NAME, "icu licen", r"icu licen[cs]e(?: icu 1 8 1 and later)?"),
    ("unicode", TEXT, "unicode data files", r"permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("postgresql", TEXT, "written agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("postgresql", NAME, "postgresql licen", r"postgresql licen[cs]e"),
    ("tcl", TEXT, "regents of the university of california sun microsystems", r"copyrighted by the regents of the university of california sun microsystems inc scriptics corporation"),
    ("vim", NAME, "vim licen", r"vim licen[cs]e"),
    ("zpl-2.1", TEXT, "zope public license zpl version 2 1", r"zope public license zpl version 2 1"),
    ("ncsa", TEXT, "university of illinois", r"university of illinois ncsa open source licen[cs]e"),
    ("llvm-exception", NOTICE, "llvm exception", r"apache license v2 0 with llvm exceptions?|with llvm exceptions?"),
    ("upl-1", TEXT, "larger work", r"a copy of this software associated documentation and or data .{0,200}larger works? to which the software is contributed"),
    ("ecl-2", NOTICE, "educational community licen", r"licensed under the educational community licen[cs]e version 2 0"),
    ("eupl-1.2", NOTICE, "eupl", r"licensed under the eupl(?: version)? 1 2(?: or)?"),
    ("cecill-2.1", NOTICE, "cecill", r"governed by the cecill(?: [bc])? license under french law"),
    ("ms-pl", TEXT, "microsoft public license ms pl", r"microsoft public license ms pl"),
    ("ms-rl", TEXT, "microsoft reciprocal license ms rl", r"microsoft reciprocal license ms rl"),
    ("ms-lpl", NAME, "microsoft limited public licen", r"microsoft limited public licen[cs]e"),
    ("polyform-noncommercial", NAME, "polyform noncommercial", r"polyform noncommercial licen[cs]e(?: 1 0 0)?"),
    ("polyform-small-business", NAME, "polyform small business", r"polyform small business licen[cs]e(?: 1 0 0)?"),
    ("elastic-2", NAME, "elastic licen", r"elastic licen[cs]e(?: version)? 2(?: 0)?"),
    ("sspl-1", NAME, "server side public licen", r"server side public licen[cs]e(?: version| v)?(?: 1)?"),
    ("busl-1.1", NAME, "business source licen", r"business source licen[cs]e(?: version)?(?: 1 1)?"),
    ("commons-clause", NOTICE, "commons clause", r"commons clause(?: license)?(?: condition)?(?: v?1 0)?"),
    ("openrail", NAME, "rail", r"(?:creative ml |bigscience |big code )?open ?rail(?: m)?(?: license)?"),
    # data, documents, media
    ("cc0-1", TEXT, "cc0 1 0 universal", r"(?:creative commons )?cc0 1 0 universal"),
    ("cc0-1", NOTICE, "publicdomain zero", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1", NOTICE, "publicdomain mark", r"creativecommons org publicdomain mark 1 0"),
    ("cc-by-4", NOTICE, "licenses by 4 0", r"creativecommons org licenses by 4 0"),
    ("cc-by-3", NOTICE, "licenses by 3 0", r"creativecommons org licenses by 3 0"),
    ("cc-by-sa-4", NOTICE, "licenses by sa 4 0", r"creativecommons org licenses by sa 4 0"),
    ("cc-by-sa-3", NOTICE, "licenses by sa 3 0", r"creativecommons org licenses by sa 3 0"),
    ("cc-by-nd-4", NOTICE, "licenses by nd 4 0", r"creativecommons org licenses by nd 4 0"),
    ("cc-by-nc-4", NOTICE, "licenses by nc 4 0", r"creativecommons org licenses by nc 4 0"),
    ("cc-by-nc-sa-4", NOTICE, "licenses by nc sa 4 0", r"creativecommons org licenses by nc sa 4 0"),
    ("cc-by-nc-nd-4", NOTICE, "licenses by nc nd 4 0", r"creativecommons org licenses by nc nd 4 0"),
    ("cc-by-sa", NOTICE, "commons attribution share", r"text is available under the creative commons attribution share ?alike licen[cs]e"),
    ("odbl-1", NOTICE, "open database licen", r"made available under the open database licen[cs]e"),
    ("odbl-1", NOTICE, "opendatacommons org licenses odbl", r"opendatacommons org licenses odbl 1 0"),
    ("pddl-1", NAME, "public domain dedication and licen", r"open data commons public domain dedication and licen[cs]e"),
    ("odc-by-1", NAME, "open data commons attribution", r"open data commons attribution licen[cs]e"),
    ("ogl-3", NOTICE, "open government licen", r"open government licen[cs]e(?: version| v)? 3 0"),
    ("ogl", NAME, "open government licen", r"open government licen[cs]e"),
    ("etalab-2", NAME, "licence ouverte", r"licence ouverte(?: open licence)?(?: version)?(?: 2 0)?"),
    ("dl-de-by-2", NAME, "datenlizenz deutschland", r"datenlizenz deutschland(?: namensnennung)?(?: version)?(?: 2 0)?"),
    ("cdla-permissive", NAME, "community data license agreement permissive", r"community data license agreement permissive(?: version)?(?: [12] 0)?"),
    ("cdla-sharing", NAME, "community data license agreement sharing", r"community data license agreement sharing(?: version)?(?: 1 0)?"),
    ("free-art-1.3", NAME, "free art licen", r"free art licen[cs]e(?: 1 3)?"),
    ("gutenberg", NOTICE, "project gutenberg licen", r"under the terms of the project gutenberg licen[cs]e"),
    ("all-rights-reserved", SHORT, "all rights reserved", r"all rights reserved"),
    ("proprietary", NOTICE, "proprietary and confidential", r"(?:this (?:software|file|document) is )?proprietary and confidential"),
    ("proprietary", NOTICE, "unauthorized copying", r"unauthorized copying of this file via any medium is strictly prohibited"),
]
