"""Signatures of licences, written for texts whose words are lower-cased and parted by single spaces.

A signature is (label, priority, expression).  Whole notices come before passages of licences,
these before ways of naming one, and bare mentions come last; an expression begins with a
word that is rare in prose; any part that repeats has a bound.
"""

from __future__ import annotations

#: Passages of notices and licences that tell which one it is.
PASSAGES: list[tuple[str, int, str]] = [
    # MIT and its kin
    ("mit", 95, "permission is hereby granted free of charge to any person obtaining a copy of this (?:software|work|font software)"),
    ("mit", 92, "permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 92, "sublicense and or sell copies of the software"),
    ("mit", 90, "(?:released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:mit|expat)(?: x11)?(?: style)? licen[cs]e"),
    ("mit", 88, "mit (?:style|like|type) licen[cs]e"),
    ("mit", 86, "modern style mit licen[cs]e"),
    ("x11", 90, "x11 (?:style )?licen[cs]e"),
    ("x11", 90, "mit x11(?: style)? licen[cs]e"),
    ("isc", 95, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 92, "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", 88, "isc (?:style )?licen[cs]e"),
    ("isc", 88, "internet systems consortium licen[cs]e"),
    ("ncsa", 96, "permission is hereby granted free of charge to any person obtaining a copy of this software (?:.{1,60} )?to deal with the software without restriction"),
    ("ncsa", 88, "university of illinois ncsa open source licen[cs]e"),
    ("zlib", 95, "altered source versions must be plainly marked as such"),
    ("zlib", 93, "misrepresented you must not claim that you wrote the original software"),
    ("zlib", 93, "freely subject to the following restrictions"),
    ("zlib", 88, "zlib(?: libpng)? licen[cs]e"),
    ("zlib", 88, "libpng licen[cs]e"),
    ("postgresql", 95, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("wtfpl", 95, "do what the fuck you want to public licen[cs]e"),
    ("beerware", 95, "buy me a beer in return"),
    ("beerware", 88, "beerware licen[cs]e"),
    ("curl", 93, "curl licen[cs]e"),
    ("unlicense", 95, "unencumbered software released into the public domain"),
    ("unlicense", 92, "dedicate any and all copyright interest in the software to the public domain"),
    ("unlicense", 90, "unlicense(?:d)? (?:org|licen[cs]e|into the public domain)"),
    # Apache
    ("apache", 96, "licensed under the apache licen[cs]e version 2 0 the licen[cs]e you may not use this file except in compliance"),
    ("apache", 95, "licensed to the apache software foundation asf under one or more contributor licen[cs]e agreements"),
    ("apache", 92, "licen[cs]e you may obtain a copy of the licen[cs]e at https? www apache org licen[cs]es"),
    ("apache", 91, "www apache org licen[cs]es licen[cs]e(?: 2 0| 1 1)?"),
    ("apache", 90, "warranties or conditions of any kind either express or implied see the licen[cs]e"),
    ("apache", 89, "(?:released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?apache(?: software)?(?: licen[cs]e)?(?: version)?(?: v)?(?: 2(?: 0)?)?"),
    ("apache", 88, "apache(?: 2(?: 0)?| v2(?: 0)?| style| software)? licen[cs]e"),
    ("apache", 86, "apache 2 0"),
    # BSD
    ("bsd", 95, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 94, "redistributions of source code must retain the above copyright notice"),
    ("bsd", 94, "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", 94, "redistributions of any form whatsoever must retain the following acknowledge?ments?"),
    ("bsd-3-clause", 94, "neither the name of .{1,200} nor the names of (?:its|any|other) contributors may be used to endorse or promote"),
    ("bsd-4-clause", 95, "advertising materials mentioning features or use of this software must display the following acknowledge?ments?"),
    ("bsd", 90, "(?:released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the |a )?(?:new |modified |simplified |revised )?bsd(?: style)? licen[cs]e"),
    ("bsd", 88, "bsd (?:style|like|type) licen[cs]e"),
    ("bsd-0-clause", 88, "(?:bsd zero|zero|0) clause(?: bsd)?(?: licen[cs]e)?"),
    ("bsd-1-clause", 88, "bsd 1 clause"),
    ("bsd-2-clause", 88, "bsd 2 clause"),
    ("bsd-2-clause", 88, "simplified bsd(?: licen[cs]e)?"),
    ("bsd-2-clause", 88, "freebsd licen[cs]e"),
    ("bsd-3-clause", 88, "bsd 3 clause"),
    ("bsd-3-clause", 88, "(?:revised|modified) bsd licen[cs]e"),
    ("bsd-4-clause", 88, "(?:bsd 4|4) clause(?: bsd)?"),
    ("bsd-4-clause", 88, "original bsd licen[cs]e"),
    # GPL family
    ("gpl", 96, "redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation"),
    ("lgpl", 96, "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e as published by the free software foundation"),
    ("agpl", 96, "redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e as published by the free software foundation"),
    ("gpl", 93, "received a copy of the gnu general public licen[cs]e along with this (?:program|software|library|package|file)"),
    ("lgpl", 93, "received a copy of the gnu (?:lesser|library) general public licen[cs]e along with this (?:program|software|library|package|file)"),
    ("agpl", 93, "received a copy of the gnu affero general public licen[cs]e along with this (?:program|software|library|package|file)"),
    ("gpl", 91, "licensed under (?:the )?gpl ?v?[123](?: 0)?(?: or later| only)?"),
    ("gpl", 90, "(?:released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:gpl|general public) licen[cs]e(?: version)?(?: ?v?[123](?: 0)?)?"),
    ("lgpl", 90, "(?:released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:lgpl|lesser general public) licen[cs]e(?: version)?(?: ?v?[123](?: [01])?)?"),
    ("agpl", 90, "(?:released|distributed|available|published|provided|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?(?:agpl|affero general public) licen[cs]e(?: version)?(?: ?v?3(?: 0)?)?"),
    ("gpl", 88, "gnu gpl ?(?:v|version )?[123](?: 0)?(?: or later| only)? licen[cs]e"),
    ("gpl", 88, "gpl ?(?:v|version )?[123](?: 0)?(?: or later| only)? licen[cs]e"),
    ("gpl", 88, "gpl compatible licen[cs]e"),
    ("gpl", 88, "gpl (?:style|like) licen[cs]e"),
    ("lgpl", 88, "lgpl ?(?:v|version )?[23](?: [01])?(?: or later| only)? licen[cs]e"),
    ("agpl", 88, "agpl ?(?:v|version )?[13](?: 0)?(?: or later| only)? licen[cs]e"),
    ("gpl", 87, "copyleft licen[cs]e"),
    ("gpl-classpath", 94, "classpath exception"),
    ("gpl-linking", 93, "special exception(?: .{1,80})? permission to link"),
    ("gfdl", 94, "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e"),
    ("gfdl", 92, "invariant sections no front cover texts and no back cover texts"),
    # Mozilla, Eclipse, Sun, European Union, Microsoft and others
    ("mpl", 96, "subject to the terms of the mozilla public licen[cs]e v 2 0"),
    ("mpl", 93, "subject to the mozilla public licen[cs]e version 1 [01]"),
    ("mpl", 92, "mpl was not distributed with this file you can obtain one at"),
    ("mpl", 88, "mpl ?(?:v|version )?[12](?: [01])? licen[cs]e"),
    ("mpl", 88, "mozilla public licen[cs]e(?: version)?(?: v)?(?: [12](?: [01])?)?"),
    ("epl", 94, "accompanying materials are made available under the terms of the eclipse public licen[cs]e"),
    ("epl", 88, "epl ?(?:v|version )?[12](?: 0)? licen[cs]e"),
    ("edl", 92, "eclipse distribution licen[cs]e"),
    ("cddl", 94, "subject to the terms of the common development and distribution licen[cs]e"),
    ("cddl", 88, "cddl ?(?:v|version )?1(?: [01])? licen[cs]e"),
    ("cpl", 92, "common public licen[cs]e"),
    ("ipl", 92, "ibm public licen[cs]e"),
    ("npl", 92, "netscape public licen[cs]e"),
    ("qpl", 92, "q public licen[cs]e"),
    ("eupl", 94, "licensed under the eupl(?: version)?(?: v)?(?: 1 [012])?"),
    ("eupl", 88, "eupl ?(?:v|version )?1 [012] licen[cs]e"),
    ("ms-pl", 92, "microsoft public licen[cs]e"),
    ("ms-rl", 92, "microsoft reciprocal licen[cs]e"),
    ("boost", 95, "distributed under the boost software licen[cs]e version 1 0"),
    ("boost", 92, "boost software licen[cs]e(?: version 1 0)?"),
    ("busl", 92, "business source licen[cs]e(?: 1 1)?"),
    ("sspl", 92, "server side public licen[cs]e"),
    ("elastic", 92, "elastic licen[cs]e(?: 2 0)?"),
    ("commons-clause", 92, "commons clause"),
    ("polyform", 92, "polyform (?:noncommercial|shield|strict|small business) licen[cs]e"),
    ("artistic", 92, "perl artistic licen[cs]e"),
    ("artistic", 90, "artistic licen[cs]e(?: version)?(?: [12](?: 0)?)?"),
    ("artistic", 90, "licensed under the same terms as perl itself"),
    ("python", 94, "psf is making python(?: .{1,40})? available to licensee on an as is basis"),
    ("python", 90, "psf licen[cs]e(?: agreement)?"),
    ("python", 90, "python licen[cs]e"),
    ("ruby", 90, "ruby licen[cs]e"),
    ("php", 94, "php licen[cs]e(?: version)?(?: [23](?: 0[01]?)?)?"),
    ("openssl", 94, "developed by the openssl project for use in the openssl toolkit"),
    ("openssl", 92, "ssleay licen[cs]e"),
    ("openssl", 88, "openssl licen[cs]e"),
    ("intel", 92, "intel open source licen[cs]e"),
    ("apsl", 92, "apple public source licen[cs]e"),
    ("nasa", 92, "nasa open source agreement"),
    ("cecill", 92, "cecill(?: [abc])?(?: licen[cs]e)?"),
    ("mulan", 92, "mulan (?:psl|permissive software licen[cs]e)"),
    ("afl", 92, "academic free licen[cs]e(?: version)?(?: v)?(?: [123](?: [01])?)?"),
    ("osl", 92, "open software licen[cs]e(?: version)?(?: v)?(?: [123](?: [01])?)?"),
    ("upl", 92, "universal permissive licen[cs]e"),
    ("w3c", 92, "w3c (?:software|document|software and document)(?: notice and)? licen[cs]e"),
    ("vim", 92, "vim licen[cs]e"),
    ("sleepycat", 92, "sleepycat licen[cs]e"),
    ("json", 95, "software shall be used for good not evil"),
    ("hippocratic", 92, "hippocratic licen[cs]e"),
    # Fonts, data and works
    ("ofl", 96, "font software is licensed under the sil open font licen[cs]e"),
    ("ofl", 92, "sil open font licen[cs]e(?: version)?(?: v)?(?: 1 1)?"),
    ("ufl", 92, "ubuntu font licen[cs]e"),
    ("bitstream-vera", 92, "bitstream vera"),
    ("odbl", 94, "open database licen[cs]e"),
    ("odbl", 90, "odbl(?: 1 0)? licen[cs]e"),
    ("odc-by", 92, "open data commons attribution licen[cs]e"),
    ("pddl", 92, "public domain dedication and licen[cs]e"),
    ("cdla", 92, "community data licen[cs]e agreement"),
    ("ogl", 92, "open government licen[cs]e"),
    ("cc0", 95, "cc0 1 0 universal"),
    ("cc0", 92, "creative commons (?:cc0|zero|public domain dedication|universal)"),
    ("cc-by-nc-nd", 95, "creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc-sa", 95, "creative commons attribution non ?commercial share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nc", 94, "creative commons attribution non ?commercial(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-nd", 94, "creative commons attribution no ?deriv(?:s|atives|ative works)(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by-sa", 94, "creative commons attribution share ?alike(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by", 93, "creative commons attribution(?: [1234] [05])?(?: international| unported| generic)?(?: licen[cs]e)?"),
    ("cc-by", 91, "creativecommons org licen[cs]es by [1234] [05]"),
    ("cc-by-sa", 91, "creativecommons org licen[cs]es by sa [1234] [05]"),
    ("cc-by-nc", 91, "creativecommons org licen[cs]es by nc [1234] [05]"),
    ("cc-by-nd", 91, "creativecommons org licen[cs]es by nd [1234] [05]"),
    ("cc-by-nc-sa", 91, "creativecommons org licen[cs]es by nc sa [1234] [05]"),
    ("cc-by-nc-nd", 91, "creativecommons org licen[cs]es by nc nd [1234] [05]"),
    ("cc0", 91, "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 91, "creativecommons org publicdomain mark 1 0"),
    # No open licence
    ("public-domain", 80, "(?:released|placed|dedicated|put|donated) (?:in|into|to) the public domain"),
    ("public-domain", 60, "public domain"),
    ("proprietary", 92, "unauthorized (?:copying|use|reproduction|distribution) (?:.{1,40} )?is strictly prohibited"),
    ("proprietary", 90, "proprietary and confidential"),
    ("proprietary", 85, "confidential and proprietary"),
    ("proprietary", 85, "end user licen[cs]e agreement"),
    ("proprietary", 60, "all rights reserved"),
    ("gpl", 85, "gpl version [123]"),
    ("lgpl", 85, "lgpl version [23]"),
    ("agpl", 85, "agpl version [123]"),
    ("copyright", 45, "copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("copyright", 40, "copyright(?: c)? [0-9]{4}"),
    ("copyright", 40, "copyrighted (?:material|work)s?"),
]

#: label and the words that name the licence, as they stand between separators.
NAMES: list[tuple[str, str]] = [
    ("mit", "mit"), ("mit", "expat"), ("x11", "x11"), ("apache", "apache(?: software)?"), ("apache", "asl"),
    ("gpl", "gnu general public"), ("gpl", "general public"), ("gpl", "gnu gpl"), ("gpl", "gpl"), ("gpl", "gplv[23]"),
    ("lgpl", "gnu lesser general public"), ("lgpl", "lesser general public"), ("lgpl", "gnu lgpl"), ("lgpl", "lgpl"),
    ("lgpl", "gnu library general public"), ("agpl", "gnu affero general public"), ("agpl", "affero general public"), ("agpl", "agpl"),
    ("bsd", "bsd"), ("bsd", "berkeley software distribution"), ("bsd-2-clause", "(?:bsd 2|2) clause(?: bsd)?"),
    ("bsd-3-clause", "(?:bsd 3|3) clause(?: bsd)?"), ("mpl", "mozilla public"), ("mpl", "mpl"), ("epl", "eclipse public"), ("epl", "epl"),
    ("cddl", "common development and distribution"), ("cddl", "cddl"), ("eupl", "european union public"), ("eupl", "eupl"),
    ("isc", "isc"), ("zlib", "zlib"), ("boost", "boost software"), ("artistic", "artistic"), ("python", "python software foundation"),
    ("postgresql", "postgresql"), ("openssl", "openssl"), ("ofl", "(?:sil )?open font"), ("odbl", "open database"), ("ncsa", "ncsa"),
    ("wtfpl", "wtfpl"), ("unlicense", "unlicense"), ("afl", "academic free"), ("osl", "open software"), ("upl", "universal permissive"),
    ("cc0", "cc0"), ("cc0", "creative commons zero"), ("cc-by", "cc by"), ("cc-by-sa", "cc by sa"), ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"), ("cc-by-nc-sa", "cc by nc sa"), ("cc-by-nc-nd", "cc by nc nd"), ("cc-by", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution share ?alike"), ("cc-by-nc", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:s|atives)"), ("gfdl", "gnu free documentation"), ("gfdl", "gfdl"),
]
VERSION = r"(?:(?: version| v)? v?[0-9]+(?: [0-9]+)?)?"
TERMS = r"(?: (?:under|by|to|with))?(?: the)?(?: (?:terms|conditions)(?: and conditions)? of)?(?: the)?"
#: Ways of naming a licence: priority, what stands before the name, what stands after it.
FORMS: list[tuple[int, str, str]] = [
    (90, "licensed" + TERMS + " ", r"(?: licen[cs]e)?" + VERSION),
    (90, "released" + TERMS + " ", r" licen[cs]e" + VERSION),
    (90, "distributed" + TERMS + " ", r" licen[cs]e" + VERSION),
    (85, "available" + TERMS + " ", r" licen[cs]e" + VERSION),
    (80, "spdx licen[cs]e identifier ", VERSION),
    (75, "", r" licen[cs]e" + VERSION),
    (70, "licen[cs]e(?: is)?(?: the)? ", VERSION),
]
