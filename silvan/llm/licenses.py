"""License notices in texts, by ordered signature rules, with DataFrame functions only.

A text is brought to words between single blanks. Rules are regular expressions over words: sentences of the licenses
themselves (SENTENCES), and notices that name one (FORMS for each of FAMILIES). Each is gated by keywords that every
match of it contains. Where detections overlap, one that lies within another of better priority is suppressed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places are counted, and their labels (fixed values).
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


@dataclass(frozen=True)
class Family:
    """label, keywords (every alternative of the name contains one), name in running text, spdx identifier (both as regular expressions over words)."""

    label: str
    keywords: tuple[str, ...]
    name: str
    spdx: str


#: Families; more specific names come first.
FAMILIES = (
    Family("agpl-3", ("affero",), "(gnu )?affero general public license( (version|v) ?3( 0)?)?", "agpl 3 0( only| or later)?"),
    Family("lgpl-2.1", ("lesser general public",), "(gnu )?lesser general public license (version|v) ?2 1", "lgpl 2 1( only| or later)?"),
    Family("lgpl-3", ("lesser general public",), "(gnu )?lesser general public license (version|v) ?3( 0)?", "lgpl 3 0( only| or later)?"),
    Family("lgpl", ("lesser general public", "library general public"), "(gnu )?(lesser|library) general public license", "lgpl"),
    Family("gpl-2", ("general public license",), "(gnu )?general public license (version|v) ?2( 0)?", "gpl 2 0( only| or later)?"),
    Family("gpl-3", ("general public license",), "(gnu )?general public license (version|v) ?3( 0)?", "gpl 3 0( only| or later)?"),
    Family("gpl", ("general public license",), "(gnu )?general public license", "gpl"),
    Family("gpl-2", ("gplv2",), "(gnu )?gplv2", "gplv2"),
    Family("gpl-3", ("gplv3",), "(gnu )?gplv3", "gplv3"),
    Family("apache-2", ("apache",), "apache (license )?((version|v) ?)?2( 0)?( license)?", "apache 2 0"),
    Family("apache-1.1", ("apache",), "apache (software )?license (version )?1 1", "apache 1 1"),
    Family("mit", ("mit",), "mit", "mit"),
    Family("mit-0", ("mit no attribution",), "mit no attribution", "mit 0"),
    Family("bsd-2-clause", ("bsd",), "(simplified bsd|bsd 2 clause|2 clause bsd)", "bsd 2 clause"),
    Family("bsd-3-clause", ("bsd",), "((new|modified|revised) bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    Family("bsd-4-clause", ("bsd",), "(original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    Family("0bsd", ("0bsd", "zero clause bsd"), "(0bsd|zero clause bsd)", "0bsd"),
    Family("isc", ("isc",), "isc", "isc"),
    Family("mpl-2", ("mozilla",), "mozilla public license( (version|v) ?2( 0)?)?", "mpl 2 0"),
    Family("epl-1", ("eclipse",), "eclipse public license (version|v) ?1( 0)?", "epl 1 0"),
    Family("epl-2", ("eclipse",), "eclipse public license( (version|v) ?2( 0)?)?", "epl 2 0"),
    Family("cddl-1", ("common development",), "common development and distribution license( (version )?1( 0)?)?", "cddl 1 0"),
    Family("eupl-1.2", ("european union",), "european union public licen[cs]e( (version |v ?)?1 2)?", "eupl 1 2"),
    Family("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution non"), "(cc by nc nd|creative commons attribution non ?commercial no ?derivatives)( [1-4] 0)?", "cc by nc nd [1-4] 0"),
    Family("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution non"), "(cc by nc sa|creative commons attribution non ?commercial share ?alike)( [1-4] 0)?", "cc by nc sa [1-4] 0"),
    Family("cc-by-nc", ("cc by nc", "creative commons attribution non"), "(cc by nc|creative commons attribution non ?commercial)( [1-4] 0)?", "cc by nc [1-4] 0"),
    Family("cc-by-sa", ("cc by sa", "creative commons attribution share"), "(cc by sa|creative commons attribution share ?alike)( [1-4] 0)?", "cc by sa [1-4] 0"),
    Family("cc-by-nd", ("cc by nd", "creative commons attribution no"), "(cc by nd|creative commons attribution no ?derivatives)( [1-4] 0)?", "cc by nd [1-4] 0"),
    Family("cc-by", ("cc by", "creative commons attribution"), "(cc by|creative commons attribution)( [1-4] 0)?", "cc by [1-4] 0"),
    Family("cc0", ("cc0",), "cc0( 1 0)?( universal)?", "cc0 1 0"),
    Family("unlicense", ("unlicense",), "unlicense", "unlicense"),
    Family("wtfpl", ("wtfpl",), "wtfpl", "wtfpl"),
    Family("zlib", ("zlib",), "zlib( libpng)?", "zlib"),
    Family("boost-1", ("boost",), "boost software license( version 1( 0)?)?", "bsl 1 0"),
    Family("artistic-2", ("artistic",), "artistic license( (version )?2( 0)?)?", "artistic 2 0"),
    Family("postgresql", ("postgresql",), "postgresql", "postgresql"),
    Family("python-2", ("python software foundation", "psf"), "(python software foundation|psf)", "psf 2 0"),
    Family("openssl", ("openssl",), "openssl", "openssl"),
    Family("ofl-1.1", ("font",), "(sil )?open font license( (version )?1 1)?", "ofl 1 1"),
    Family("odbl-1", ("database",), "open (data commons open )?database license( (version |v ?)?1 0)?", "odbl 1 0"),
    Family("ms-pl", ("microsoft",), "microsoft public license", "ms pl"),
    Family("ms-rl", ("microsoft",), "microsoft reciprocal license", "ms rl"),
)
#: Forms of a notice, best first: (pattern with {name} or {spdx}, confidence, what any match of it contains). Each family has a rule of each form.
FORMS = (
    ("spdx license identifier {spdx}", 1.0, "spdx"),
    ("(is |are )?(licensed|released|distributed|made available|published) (to you )?under (the )?(terms (and conditions )?of )?(the )?{name}( licen[cs]e)?", 0.95, " under "),
    ("(permission|rights) (is|are) (hereby )?granted under (the )?{name}( licen[cs]e)?", 0.95, " under "),
    ("subject to (the )?(terms (and conditions )?of )?(the )?{name}( licen[cs]e)?", 0.9, " subject to "),
    ("under (the )?(terms of (the )?)?{name}( licen[cs]e)?", 0.85, " under "),
    ("(see|read) (the )?{name} licen[cs]e", 0.8, "licen[cs]e"),
    ("licen[cs]e {name}", 0.7, "licen[cs]e"),
    ("{name} licen[cs]e", 0.6, "licen[cs]e"),
)
#: Sentences of the licenses themselves: (label, confidence, words that every match contains, pattern over words). Sentences that
#: several licenses share come last and name the group.
SENTENCES = (
    ("agpl-3", 1.0, "affero general public license", "gnu affero general public license version 3 19 november 2007"),
    ("agpl-3", 0.9, "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("agpl-3", 0.95, "affero general public license", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("agpl-3", 0.9, "interacting with it remotely", "users interacting with it remotely through a computer network"),
    ("agpl-1", 0.9, "affero inc", "copyright (c )?2002 affero inc"),
    ("gpl-3", 1.0, "general public license version 3", "gnu general public license version 3 29 june 2007"),
    ("gpl-2", 1.0, "general public license version 2", "gnu general public license version 2 june 1991"),
    ("gpl-1", 1.0, "general public license version 1", "gnu general public license version 1 february 1989"),
    ("gpl-3", 0.95, "either version 3", "published by the free software foundation either version 3( of the license)?"),
    ("gpl-2", 0.95, "either version 2", "published by the free software foundation either version 2( of the license)?"),
    ("gpl-1", 0.95, "either version 1", "published by the free software foundation either version 1( of the license)?"),
    ("gpl-2", 0.95, "version 2 of the license", "published by the free software foundation version 2 of the license"),
    ("gpl-3", 0.9, "basic permissions", "basic permissions all rights granted under this license are granted for the term of copyright"),
    ("gpl-3", 0.9, "anti circumvention law", "protecting users legal rights from anti circumvention law"),
    ("gpl-3", 0.85, "installation information", "installation information for a user product means any methods"),
    ("gpl-2", 0.9, "work based on the program", "a work based on the program means either the program or any derivative work"),
    ("gpl", 0.9, "free software you can redistribute", "this (program|software|file|library) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 0.8, "you should have received a copy of the gnu general", "you should have received a copy of the gnu general public license along with this (program|software|file)"),
    ("gpl", 0.75, "gnu org licenses gpl", "(http|https) www gnu org licenses gpl (html|txt)"),
    ("gpl-2", 0.8, "gnu org licenses old licenses gpl 2", "www gnu org licenses old licenses gpl 2 0"),
    ("gpl", 0.7, "copyleft license for software", "the gnu general public license is a free copyleft license for software"),
    ("gpl", 0.7, "take away your freedom", "licenses for most software are designed to take away your freedom to share and change it"),
    ("lgpl-3", 1.0, "lesser general public license version 3", "gnu lesser general public license version 3 29 june 2007"),
    ("lgpl-2.1", 1.0, "lesser general public license version 2 1", "gnu lesser general public license version 2 1 february 1999"),
    ("lgpl-2", 1.0, "library general public license version 2", "gnu library general public license version 2 june 1991"),
    ("lgpl", 0.9, "terms of the gnu lesser", "redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl-2", 0.9, "terms of the gnu library", "redistribute it and or modify it under the terms of the gnu library general public license"),
    ("lgpl-2.1", 0.85, "work that uses the library", "a program that contains no derivative of any portion of the library but is designed to work with the library by being compiled or linked with it is called a work that uses the library"),
    ("lgpl-3", 0.85, "additional permissions listed below", "the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below"),
    ("gfdl-1.3", 1.0, "free documentation license", "gnu free documentation license version 1 3"),
    ("gfdl-1.2", 1.0, "free documentation license", "gnu free documentation license version 1 2"),
    ("gfdl-1.1", 1.0, "free documentation license", "gnu free documentation license version 1 1"),
    ("gfdl", 0.85, "no invariant sections", "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-classpath-exception", 0.9, "linking this library", "linking this library statically or dynamically with other modules is making a combined work"),
    ("gcc-exception-3.1", 0.9, "gcc runtime library exception", "gcc runtime library exception version 3 1"),
    ("apache-2", 1.0, "apache license version 2", "apache license version 2 0 january 2004"),
    ("apache-2", 0.95, "except in compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2", 0.9, "apache org licenses license 2", "(http|https) www apache org licenses license 2 0"),
    ("apache-2", 0.85, "grant of patent license", "grant of patent license subject to the terms and conditions of this license each contributor hereby grants"),
    ("apache-2", 0.8, "distributed on an as is basis", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-1.1", 0.95, "apache software license version 1 1", "the apache software license version 1 1"),
    ("apache-1.1", 0.85, "software developed by the apache", "this product includes software developed by the apache software foundation"),
    ("apache-1", 0.85, "software developed by the apache group", "this product includes software developed by the apache group for use in the apache http server project"),
    ("mit", 1.0, "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 0.8, "permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 0.7, "the authors or copyright holders be liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("x11", 0.9, "name of the x consortium", "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-modern", 0.9, "without fee and without a signed", "to use copy modify and distribute this software and its documentation for any purpose without fee and without a signed licensing agreement"),
    ("mit-cmu", 0.9, "appear in supporting documentation", "both that copyright notice and this permission notice appear in supporting documentation"),
    ("mit-feh", 0.85, "acknowledgment shall be given", "acknowledgment shall be given in the documentation and software packages that this software was used"),
    ("ntp", 0.9, "for any purpose with or without fee", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("isc", 1.0, "and or distribute this software for any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", 0.95, "and or distribute this software for any purpose", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd-4-clause", 0.95, "must display the following acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-4-clause-uc", 0.95, "university of california berkeley", "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-3-clause", 0.95, "endorse or promote products", "neither the name of the (copyright holder|author|university|organization|company) nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-3-clause", 0.9, "endorse or promote products", "the name of the author may not be used to endorse or promote products derived from this software"),
    ("bsd-3-clause-clear", 0.95, "no express or implied licenses to any party", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-2-clause-views", 0.9, "views and conclusions contained", "the views and conclusions contained in the software and documentation are those of the authors"),
    ("bsd-2-clause-patent", 0.9, "subject to the terms and conditions of this license each copyright holder", "subject to the terms and conditions of this license each copyright holder and contributor hereby grants"),
    ("bsd", 0.85, "in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd", 0.7, "redistributions in binary form", "redistributions in binary form must reproduce the above copyright notice this list of conditions"),
    ("bsd", 0.6, "bsd style license", "a bsd style license that can be found in the license file"),
    ("mpl-2", 1.0, "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2", 0.9, "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses"),
    ("mpl-2", 0.8, "mozilla org mpl 2", "(http|https) mozilla org mpl 2 0"),
    ("mpl-1.1", 0.95, "mozilla public license version 1 1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1", 0.95, "mozilla public license version 1 0", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", 0.95, "netscape public license", "the contents of this file are subject to the netscape public license version 1 1"),
    ("epl-2", 1.0, "eclipse public license", "made available under the terms of the eclipse public license 2 0"),
    ("epl-2", 0.9, "eclipse org legal epl", "(http|https) www eclipse org legal epl (2 0|v20 html)"),
    ("epl-1", 1.0, "eclipse public license", "made available under the terms of the eclipse public license v1 0"),
    ("epl-1", 0.9, "eclipse org legal epl v10", "(http|https) www eclipse org legal epl v10 html"),
    ("cpl-1", 0.95, "common public license", "the accompanying program is provided under the terms of this common public license"),
    ("ipl-1", 0.95, "ibm public license", "the accompanying program is provided under the terms of this ibm public license"),
    ("cddl-1.1", 1.0, "common development and distribution license", "common development and distribution license cddl version 1 1"),
    ("cddl-1", 1.0, "common development and distribution license", "common development and distribution license cddl version 1 0"),
    ("cddl-1", 0.9, "common development and distribution license", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("eupl-1.2", 0.95, "european union public licence", "european union public licence v 1 2 eupl"),
    ("eupl-1.1", 0.95, "european union public licence", "european union public licence v 1 1 eupl"),
    ("cecill-2.1", 1.0, "cecill", "cecill free software license agreement version 2 1"),
    ("cecill-2", 0.95, "cecill", "contrat de licence de logiciel libre cecill version 2 0"),
    ("cecill-b", 0.95, "cecill b", "cecill b free software license agreement"),
    ("cecill-c", 0.95, "cecill c", "cecill c free software license agreement"),
    ("osl-3", 0.95, "open software license", "licensed under the open software license version 3 0"),
    ("afl-3", 0.95, "academic free license", "licensed under the academic free license version 3 0"),
    ("artistic-1", 0.95, "artistic", "the artistic license preamble the intent of this document is to state the conditions under which a package may be copied"),
    ("artistic-2", 0.95, "artistic license 2", "the artistic license 2 0 copyright (c )?2000 2006 the perl foundation"),
    ("perl", 0.85, "same terms as perl", "(redistribute it and or modify it )?under the same terms as perl( itself)?"),
    ("ruby", 0.85, "same terms as ruby", "(redistribute it and or modify it )?under the same terms as ruby( itself)?"),
    ("python-2", 0.95, "python software foundation license version 2", "python software foundation license version 2"),
    ("python-2", 0.85, "this license agreement is between the python", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("cnri-python", 0.9, "national research initiatives", "this license agreement is between the corporation for national research initiatives"),
    ("php-3.01", 0.95, "php license", "this source file is subject to version 3 01 of the php license"),
    ("php-3", 0.95, "php license", "this source file is subject to version 3 0 of the php license"),
    ("zpl-2.1", 0.95, "zope public license", "zope public license zpl version 2 1"),
    ("zpl-2", 0.95, "zope public license", "zope public license zpl version 2 0"),
    ("tcl", 0.9, "regents of the university of california sun", "this software is copyrighted by the regents of the university of california sun microsystems"),
    ("openssl", 0.95, "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", 0.95, "eric young", "this product includes cryptographic software written by eric young"),
    ("zlib", 0.95, "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 0.8, "altered source versions", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", 0.95, "png reference library", "the png reference library is supplied as is"),
    ("libpng-2", 0.95, "png reference library license version 2", "png reference library license version 2"),
    ("ijg", 0.95, "independent jpeg group", "this software is based in part on the work of the independent jpeg group"),
    ("libtiff", 0.9, "sam leffler", "the names of sam leffler and silicon graphics may not be used in any advertising"),
    ("freetype", 0.95, "freetype", "portions of this software are copyright (c )?(the )?freetype project"),
    ("curl", 0.9, "daniel stenberg", "copyright (c )?(1996 20[0-9][0-9] )?daniel stenberg"),
    ("boost-1", 1.0, "boost software license", "distributed under the boost software license version 1 0"),
    ("boost-1", 0.9, "machine executable object code", "solely in the form of machine executable object code generated by a source language processor"),
    ("unlicense", 1.0, "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 0.85, "unlicense org", "for more information please refer to (http|https) unlicense org"),
    ("wtfpl", 0.95, "what the", "do what the f[a-z]ck you want to public license"),
    ("cc0", 1.0, "cc0 1 0 universal", "creative commons legal code cc0 1 0 universal"),
    ("cc0", 0.9, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc0", 0.85, "waived all copyright", "has waived all copyright and related or neighboring rights to this work"),
    ("cc-pdm", 0.9, "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", 0.95, "creativecommons org licenses by", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", 0.95, "creativecommons org licenses by sa", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", 0.95, "creativecommons org licenses by nd", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", 0.95, "creativecommons org licenses by nc", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", 0.95, "creativecommons org licenses by nc sa", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 0.95, "creativecommons org licenses by nc nd", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-sa", 0.9, "attribution sharealike", "creative commons attribution sharealike [1-4] 0 (international|unported|generic)"),
    ("cc-by-nc-nd", 0.9, "attribution noncommercial noderivatives", "creative commons attribution noncommercial noderivatives [1-4] 0 (international|unported|generic)"),
    ("cc-by-nc-sa", 0.9, "attribution noncommercial sharealike", "creative commons attribution noncommercial sharealike [1-4] 0 (international|unported|generic)"),
    ("odbl-1", 0.95, "open database license", "made available under the open database license"),
    ("odc-by-1", 0.95, "open data commons attribution", "open data commons attribution license"),
    ("pddl-1", 0.95, "open data commons public domain", "open data commons public domain dedication and licen[cs]e"),
    ("ogl-uk-3", 0.95, "open government licence", "licensed under the open government licence v3 0"),
    ("ofl-1.1", 1.0, "sil open font license", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 0.85, "reserved font name", "with reserved font name"),
    ("bitstream-vera", 0.95, "the fonts accompanying", "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this license"),
    ("lppl-1.3c", 0.95, "project public license", "distributed and or modified under the conditions of the latex project public license"),
    ("ms-pl", 0.95, "microsoft public license", "microsoft public license ms pl this license governs use of the accompanying software"),
    ("ms-rl", 0.95, "microsoft reciprocal license", "microsoft reciprocal license ms rl this license governs use of the accompanying software"),
    ("postgresql", 0.95, "postgresql database management system", "postgresql database management system formerly known as postgres"),
    ("ncsa", 0.95, "university of illinois", "university of illinois ncsa open source license"),
    ("ecl-2", 0.95, "educational community license", "licensed under the educational community license version 2 0"),
    ("ecl-1", 0.95, "educational community license", "licensed under the educational community license version 1 0"),
    ("w3c", 0.95, "w3c", "w3c software (notice and license|and document notice and license)"),
    ("unicode-dfs", 0.95, "unicode inc license agreement", "unicode inc license agreement data files and software"),
    ("icu", 0.9, "icu license", "icu license icu 1 8 1 and later"),
    ("json", 0.95, "for good not evil", "the software shall be used for good not evil"),
    ("beerware", 0.95, "beer ware license", "the beer ware license revision 42"),
    ("fair", 0.8, "usage of the works is permitted", "usage of the works is permitted provided that this instrument is retained with the works"),
    ("vim", 0.95, "vim license", "permission is granted to distribute this software under the vim license"),
    ("sleepycat", 0.95, "sleepycat", "the sleepycat license"),
    ("qpl-1", 0.95, "q public license", "the q public license version 1 0"),
    ("ssh-openssh", 0.85, "as far as i am concerned", "as far as i am concerned the code i have written for this software can be used freely for any purpose"),
    ("bzip2", 0.9, "julian seward", "copyright (c )?(1996 20[0-9][0-9] )?julian seward"),
    ("sspl-1", 0.95, "server side public license", "server side public license version 1"),
    ("busl-1.1", 0.95, "business source license", "business source license 1 1"),
    ("busl-1.1", 0.8, "additional use grant", "additional use grant"),
    ("elastic-2", 0.95, "elastic license", "elastic license 2 0"),
    ("commons-clause", 0.95, "commons clause", "commons clause license condition v1 0"),
    ("polyform-nc-1", 0.95, "polyform noncommercial", "polyform noncommercial license 1 0 0"),
    ("upl-1", 0.95, "universal permissive license", "the universal permissive license upl version 1 0"),
    ("mulan-psl-2", 0.95, "mulan psl", "licensed under mulan psl v2"),
    ("oracle-free", 0.8, "oracle free use terms", "oracle free use terms and conditions"),
    ("rail-m", 0.9, "open rail m", "bigscience open rail m license"),
    ("llama-community", 0.9, "llama", "llama [23] community license agreement"),
    ("proprietary", 0.6, "all rights reserved", "all rights reserved (no part of this|unauthorized (copying|reproduction))"),
    ("proprietary", 0.6, "confidential and proprietary", "this (software|document|file) is confidential and proprietary"),
    ("public-domain", 0.8, "public domain", "(is|are) (hereby )?(placed in|released into|dedicated to) the public domain"),
    ("public-domain", 0.7, "united states government", "this (software|work) is a work of the united states government"),
)
#: A text without any of these has no notice, so no detection beyond sentences and the phrases' places.
GATE = "|".join(dict.fromkeys(held for _, _, held in FORMS))
#: Nor without one of these; plain strings, since many alternatives make a pattern slow at every place of a text.
GATES = tuple(dict.fromkeys(held for _, _, held, _ in SENTENCES))


def rules() -> list[tuple[tuple[str, ...], str, int, float, str]]:
    """(keywords, label, priority, confidence, pattern) of every rule; a smaller priority is better. Sentences of licenses come
    first, then notices; more specific forms and families come first."""
    out = [((held,), label, i, confidence, f" {pattern}(?= )") for i, (label, confidence, held, pattern) in enumerate(SENTENCES)]
    for f, (form, confidence, _) in enumerate(FORMS):
        for i, family in enumerate(FAMILIES):
            body = form.replace("{name}", f"({family.name})").replace("{spdx}", f"({family.spdx})")
            out.append((("spdx",) if "{spdx}" in form else family.keywords, family.label, len(SENTENCES) + f * len(FAMILIES) + i, confidence, f" {body}(?= )"))
    return out


def _blanks(s: Column) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))


def _places(norm: Column, rule: Column) -> Column:
    """Detections of one rule. A match begins with the blank before its first word, so blanks count words."""

    def add(state: Column, i: Column, x: Column) -> Column:
        start = state["at"] + _blanks(x["g"][i])
        end = start + _blanks(x["h"][i])
        found = F.struct(rule["priority"].alias("priority"), start.alias("start"), end.alias("end"), rule["label"].alias("label"), rule["confidence"].alias("confidence"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    empty = F.array().cast("array<struct<priority:int,start:int,end:int,label:string,confidence:double>>")
    held = F.array(F.struct(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)).alias("h"), F.split(norm, rule["pattern"], -1).alias("g")))
    walk = lambda x: F.aggregate(F.sequence(F.lit(0), F.size(x["h"]) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda s, i: add(s, i, x), lambda s: s["out"])
    return F.flatten(F.transform(F.filter(held, lambda x: F.size(x["h"]) > 0), walk))


def detections(norm: Column) -> Column:
    """array<struct<priority, start, end, label, confidence>> that no better one contains; start and end (exclusive) count words."""
    by_keywords: dict[tuple[str, ...], list] = {}
    for keywords, label, priority, confidence, pattern in rules():
        by_keywords.setdefault(keywords, []).append(F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"), F.lit(pattern).alias("pattern")))
    families = F.array(*[F.struct(F.array(*map(F.lit, k)).alias("keywords"), F.array(*r).alias("rules")) for k, r in by_keywords.items()])
    open_ = F.filter(families, lambda f: F.exists(f["keywords"], lambda k: F.contains(norm, k)))
    found = F.flatten(F.transform(F.flatten(F.transform(open_, lambda f: f["rules"])), lambda r: _places(norm, r)))
    inside = lambda d, e: (e["start"] <= d["start"]) & (e["end"] >= d["end"])
    best = F.transform(F.array(found), lambda all_: F.filter(all_, lambda d: ~F.exists(all_, lambda e: (e["priority"] < d["priority"]) & inside(d, e))))[0]
    some = reduce(or_, [F.contains(norm, F.lit(k)) for k in GATES], norm.rlike(GATE))
    return F.when(some, best).otherwise(F.array().cast("array<struct<priority:int,start:int,end:int,label:string,confidence:double>>"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of PHRASES; first_word and last_word are their smallest and largest start in words, null
    without any. labels are those of the phrases and of all detections; score is the best confidence (0 without labels).
    A null text counts as empty: no words, no labels. Lower-casing goes beyond A-Z, but no letter outside them becomes
    one of a phrase's. No shuffle.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), BETWEEN, " "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain.alias("plain"))
    rows = rows.select("doc_id", F.when(F.col("plain") == "", 0).otherwise(_blanks(F.col("plain")) + 1).cast("long").alias("n_words"), F.concat(F.lit(" "), "plain", F.lit(" ")).alias("norm"))
    norm, n = F.col("norm"), F.col("n_words")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES:
        there = F.contains(norm, F.lit(f" {phrase} "))
        counts.append(F.when(there, F.size(F.split(norm, f" {phrase}(?= )", -1)) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(there, _blanks(F.substring_index(norm, f" {phrase} ", 1)).cast("long")))
        lasts.append(F.when(there, n - _blanks(F.substring_index(norm, f" {phrase} ", -1)) - len(phrase.split())))
        labels.append(F.when(there, F.lit(label)))
    rows = rows.select("doc_id", "n_words", sum(counts[1:], counts[0]).alias("n_base"), F.least(*firsts).alias("first_word"), F.greatest(*lasts).alias("last_word"), F.array_compact(F.array(*labels)).alias("base"), detections(norm).alias("found"))
    every = F.array_sort(F.array_union("base", F.transform("found", lambda d: d["label"])))
    score = F.greatest(F.when(F.size("base") > 0, 0.85).otherwise(0.0), F.coalesce(F.array_max(F.transform("found", lambda d: d["confidence"])), F.lit(0.0)))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
