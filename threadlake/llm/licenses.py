"""License scans: an ordered list of signature rules over a text's words.

A text is read as its lower-cased words (letters and digits, anything else
separates), joined by single blanks; a rule is a regex over that string, so a
phrase is found across line breaks, comment marks and punctuation. Every rule
names a keyword that any match must hold. One Aho-Corasick pass over the raw text
finds the keywords it has; most texts have none and no regex runs on them.

Detections overlap ("apache license version 2 0" also is "apache license"). They
are taken in order of priority, then length, then place, and one whose interval
of words lies within the interval of a detection already taken is suppressed. The
rules are hand-written: a name and an identifier for each license, and sentences of
license texts, headers, exceptions and notices.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadlake.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The places that are counted and the labels that always stay.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    keyword: str
    pattern: re.Pattern[str]
    priority: int
    score: float


# (label, keyword, regex for the license's name, regex for its SPDX identifier) as words in lower case.
LICENSES: tuple[tuple[str, str, str, str], ...] = (
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", r"agpl 3 0(?: only| or later)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public license", r"agpl"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: version| v)? ?2 1", r"lgpl 2 1(?: only| or later)?"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?", r"lgpl 3 0(?: only| or later)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public license", r"lgpl"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public license", r"lgpl 2 0(?: only| or later)?"),
    ("gpl-1.0", "general", r"(?:gnu )?general public license(?: version| v) ?1(?: 0)?", r"gpl 1 0(?: only| or later)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license(?: version| v) ?2(?: 0)?", r"gpl 2 0(?: only| or later)?"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license(?: version| v) ?3(?: 0)?", r"gpl 3 0(?: only| or later)?"),
    ("gpl", "general", r"gnu general public license", r"gpl"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation license(?: version| v) ?1 3", r"gfdl 1 3(?: only| or later)?"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license", r"gfdl"),
    ("apache-1.1", "apache", r"apache (?:software )?license(?: version| v)? ?1 1", r"apache 1 1"),
    ("apache-2.0", "apache", r"apache (?:software )?license(?: version| v)? ?2(?: 0)?", r"apache 2 0"),
    ("apache", "apache", r"apache (?:software )?license", r"apache"),
    ("mit", "mit", r"(?:the )?mit (?:x11 )?license", r"mit"),
    ("mit-0", "attribution", r"mit no attribution(?: license)?", r"mit 0"),
    ("x11", "x11", r"x11 license", r"x11"),
    ("expat", "expat", r"expat license", r"expat"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|bsd 2 clause|2 clause bsd)(?: license)?", r"bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: license)?", r"bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|bsd 4 clause|4 clause bsd)(?: license)?", r"bsd 4 clause"),
    ("0bsd", "bsd", r"(?:zero clause bsd|bsd zero clause)(?: license)?", r"0bsd"),
    ("bsd", "bsd", r"bsd(?: style)? license", r"bsd"),
    ("isc", "isc", r"isc license", r"isc"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? ?1 1", r"mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version| v)? ?2 0", r"mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public license", r"mpl"),
    ("npl", "netscape", r"netscape public license", r"npl 1 [01]"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version| v)? ?1 0", r"epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version| v)? ?2 0", r"epl 2 0"),
    ("epl", "eclipse", r"eclipse public license", r"epl"),
    ("edl-1.0", "eclipse", r"eclipse distribution license", r"edl 1 0"),
    ("eupl-1.2", "european", r"european union public licen[cs]e", r"eupl 1 [012]"),
    ("cddl-1.0", "development", r"common development and distribution license", r"cddl 1 [01]"),
    ("cpl-1.0", "common", r"common public license", r"cpl 1 0"),
    ("cpal-1.0", "attribution", r"common public attribution license", r"cpal 1 0"),
    ("ipl-1.0", "ibm", r"ibm public license", r"ipl 1 0"),
    ("apsl-2.0", "apple", r"apple public source license", r"apsl 2 0"),
    ("artistic-1.0", "artistic", r"artistic license(?: version| v)? ?1 0", r"artistic 1 0(?: perl)?"),
    ("artistic-2.0", "artistic", r"artistic license(?: version| v)? ?2 0", r"artistic 2 0"),
    ("artistic", "artistic", r"artistic license", r"artistic"),
    ("bsl-1.0", "boost", r"boost software license", r"bsl 1 0"),
    ("busl-1.1", "business", r"business source license", r"busl 1 1"),
    ("sspl-1.0", "server", r"server side public license", r"sspl 1 0"),
    ("elastic-2.0", "elastic", r"elastic license", r"elastic 2 0"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?", r"cc0 1 0"),
    ("cc-by-4.0", "commons", r"creative commons attribution(?: license)?(?: version| v)? ?4 0(?: international)?", r"cc by 4 0"),
    ("cc-by-3.0", "commons", r"creative commons attribution(?: license)?(?: version| v)? ?3 0(?: unported)?", r"cc by 3 0"),
    ("cc-by-sa-4.0", "commons", r"creative commons attribution share ?alike(?: license)?(?: 4 0)?", r"cc by sa 4 0"),
    ("cc-by-nc-4.0", "commons", r"creative commons attribution non ?commercial(?: license)?(?: 4 0)?", r"cc by nc 4 0"),
    ("cc-by-nd-4.0", "commons", r"creative commons attribution no ?derivat(?:ive|ives)(?: works)?(?: 4 0)?", r"cc by nd 4 0"),
    ("cc-by-nc-sa-4.0", "commons", r"creative commons attribution non ?commercial share ?alike(?: 4 0)?", r"cc by nc sa 4 0"),
    ("cc", "commons", r"creative commons (?:public )?license", r"cc by"),
    ("odbl-1.0", "database", r"open (?:data commons open )?database license", r"odbl 1 0"),
    ("odc-by-1.0", "commons", r"open data commons attribution license", r"odc by 1 0"),
    ("pddl-1.0", "dedication", r"public domain dedication and licen[cs]e", r"pddl 1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", r"zlib"),
    ("libpng", "libpng", r"libpng license", r"libpng(?: 2 0)?"),
    ("psf-2.0", "python", r"python software foundation license", r"psf 2 0"),
    ("python-2.0", "python", r"python license", r"python 2 0"),
    ("php-3.01", "php", r"php license", r"php 3 01"),
    ("ruby", "ruby", r"ruby license", r"ruby"),
    ("openssl", "openssl", r"openssl license", r"openssl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("ncsa", "illinois", r"university of illinois (?:ncsa )?open source license", r"ncsa"),
    ("w3c", "w3c", r"w3c software (?:notice and )?license", r"w3c"),
    ("ofl-1.1", "font", r"(?:sil )?open font license", r"ofl 1 1"),
    ("vim", "vim", r"vim license", r"vim"),
    ("curl", "curl", r"curl license", r"curl"),
    ("ms-pl", "microsoft", r"microsoft public license", r"ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", r"ms rl"),
    ("osl-3.0", "open", r"open software license", r"osl 3 0"),
    ("afl-3.0", "academic", r"academic free license", r"afl 3 0"),
    ("ecl-2.0", "educational", r"educational community license", r"ecl 2 0"),
    ("upl-1.0", "universal", r"universal permissive license", r"upl 1 0"),
    ("mulan-2.0", "mulan", r"mulan (?:permissive|psl) (?:software )?license", r"mulanpsl 2 0"),
    ("qpl-1.0", "public", r"q public license", r"qpl 1 0"),
    ("sleepycat", "sleepycat", r"sleepycat license", r"sleepycat"),
    ("blueoak-1.0.0", "blue", r"blue oak model license", r"blueoak 1 0 0"),
    ("parity-7.0.0", "parity", r"parity public license", r"parity 7 0 0"),
)

# Sentences of license texts, headers, grants, version clauses, exceptions and notices (label, keyword, regex, score).
NOTICES: tuple[tuple[str, str, str, float], ...] = (
    # permissive texts
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.95),
    ("mit", "sublicense", r"to use copy modify merge publish distribute sublicense and or sell copies", 0.9),
    ("mit", "substantial", r"(?:the )?above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.9),
    ("mit", "tort", r"whether in an action of contract tort or otherwise arising from out of or in connection with the software", 0.8),
    ("mit-0", "furnished", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 0.9),
    ("x11", "advertising", r"except as contained in this notice the names? of .{1,60}? shall not be used in advertising or otherwise to promote the sale", 0.9),
    ("isc", "hereby", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 0.95),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software", 0.8),
    ("0bsd", "hereby", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", 0.95),
    ("hpnd", "hereby", r"permission to use copy modify and distribute this software and its documentation for any purpose (?:and )?without fee is hereby granted", 0.9),
    ("hpnd", "publicity", r"not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission", 0.85),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.95),
    ("bsd", "redistributions", r"redistributions of source code must retain the above copyright notice this list of conditions", 0.9),
    ("bsd", "redistributions", r"redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-3-clause", "endorse", r"may be used to endorse or promote products derived from this software", 0.9),
    ("bsd-3-clause", "contributors", r"neither the names? of .{1,80}? nor the names of (?:its|other|the) contributors", 0.9),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 0.95),
    ("bsd-4-clause", "includes", r"this product includes software developed by", 0.6),
    ("bsd-source-code", "conspicuously", r"redistributions? (?:or derivations )?of source code must (?:conspicuously )?retain", 0.6),
    ("bsd-patent", "perpetual", r"subject to the terms and conditions of this license each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual", 0.9),
    ("bsd-nuclear", "nuclear", r"not designed licensed or intended for use in the design construction operation or maintenance of any nuclear facility", 0.9),
    ("zlib", "warranty", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.9),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented", 0.9),
    ("zlib", "altered", r"altered source versions must be plainly marked as such", 0.9),
    ("libpng", "disclaimer", r"libpng versions? .{1,60}? (?:is|are) distributed according to the same disclaimer and license", 0.9),
    ("bsl-1.0", "executable", r"solely in the form of machine executable object code generated by a source language processor", 0.95),
    ("ncsa", "disclaimers", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", 0.8),
    ("postgresql", "paragraph", r"without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies", 0.95),
    ("curl", "curl", r"curl and libcurl are licensed under a mit x derivate license", 0.95),
    ("fair", "instrument", r"usage of the works is permitted provided that this instrument is retained", 0.95),
    ("beerware", "beer", r"you can buy me a beer in return", 0.95),
    ("beerware", "beer", r"the beer ware license", 0.95),
    ("wtfpl", "fuck", r"do what the fuck you want to(?: public license)?", 0.95),
    ("json", "evil", r"the software shall be used for good not evil", 0.95),
    ("naist", "institute", r"nara institute of science and technology", 0.7),
    ("icu", "hereby", r"permission is hereby granted .{1,60}? provided that the above copyright notice s and this permission notice appear in all copies of the software", 0.9),
    ("unicode", "unicode", r"unicode data files or software", 0.8),
    ("unicode", "unicode", r"unicode (?:inc )?license agreement(?: data files and software)?", 0.9),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group", 0.95),
    ("ftl", "freetype", r"portions of this software are copyright .{1,40}? the freetype project", 0.95),
    ("ftl", "freetype", r"(?:the )?freetype (?:project )?license", 0.9),
    ("info-zip", "zip", r"info zip license", 0.9),
    ("bzip2", "bzip2", r"bzip2 (?:and libbzip2 )?license", 0.9),
    ("openssl", "openssl", r"this product includes software developed by the openssl project", 0.95),
    ("openssl", "eric", r"this product includes cryptographic software written by eric young", 0.95),
    ("tcl", "licensing", r"modifications to this software may be copyrighted by their authors and need not follow the licensing terms described here", 0.95),
    ("ruby", "redistribute", r"you can redistribute it and or modify it under either the terms of the (?:2 clause bsdl|gpl)", 0.8),
    ("artistic-1.0", "intent", r"the intent of this document is to state the conditions under which a package may be copied", 0.95),
    ("artistic", "perl", r"under the same terms as perl(?: itself)?", 0.9),
    ("php-3.01", "php", r"this product includes php software freely available", 0.95),
    ("psf-2.0", "python", r"psf is making python available to licensee on an as is basis", 0.95),
    ("cnri-python", "cnri", r"cnri is making (?:this|python) .{1,40}? available to licensee on an as is basis", 0.95),
    ("w3c", "royalty", r"permission to copy modify and distribute this (?:software|work) and its documentation with or without modification for any purpose and without fee or royalty", 0.9),
    ("ofl-1.1", "font", r"the font software may be sold as part of a larger software package", 0.9),
    ("ofl-1.1", "reserved", r"with reserved font names?", 0.9),
    ("upl-1.0", "collectively", r"to any person obtaining a copy of this software associated documentation and or data collectively the software", 0.9),
    ("afl-3.0", "academic", r"licensed under the academic free license", 0.95),
    ("cecill", "cecill", r"(?:governed by|under) the cecill(?: [bc])? license(?: under french law)?", 0.95),
    ("cecill", "cecill", r"cecill(?: [bc])? free software license agreement", 0.95),
    # Apache
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license", 0.9),
    ("apache-2.0", "applicable", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", 0.9),
    ("apache-2.0", "apache", r"apache org licenses license 2 0", 0.8),
    ("apache-2.0", "contributor", r"licensed to the apache software foundation asf under one or more contributor license agreements", 0.95),
    ("apache-2.0", "irrevocable", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable(?: except as stated in this section)? patent license", 0.9),
    ("apache-1.1", "foundation", r"this product includes software developed by the apache software foundation", 0.9),
    ("llvm-exception", "llvm", r"(?:with )?llvm exceptions?", 0.9),
    ("commons-clause", "commons", r"commons clause(?: license)? condition", 0.95),
    ("commons-clause", "sell", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software", 0.95),
    # copyleft: headers, versions, exceptions
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public license", 0.95),
    ("gpl", "warranty", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", 0.95),
    ("gpl", "received", r"you should have received a copy of the gnu general public license", 0.95),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document", 0.8),
    ("gpl", "designed", r"licenses for (?:most|software) .{0,40}?are designed to take away your freedom to share and change", 0.9),
    ("gpl", "free", r"the gnu general public license is a free copyleft license for software", 0.95),
    ("gpl", "gpl", r"(?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?gpl", 0.8),
    ("gpl-1.0-or-later", "later", r"version 1 or at your option any later version", 0.7),
    ("gpl-2.0-only", "version", r"gnu general public license version 2 only", 0.95),
    ("gpl-2.0-only", "gplv2", r"gplv2(?: only)?", 0.7),
    ("gpl-2.0-or-later", "later", r"gnu general public license as published by the free software foundation either version 2 of the license or (?:at your option )?any later version", 0.95),
    ("gpl-2.0-or-later", "gplv2", r"gplv2(?: or later| plus)", 0.8),
    ("gpl-3.0-or-later", "later", r"gnu general public license as published by the free software foundation either version 3 of the license or (?:at your option )?any later version", 0.95),
    ("gpl-3.0", "gplv3", r"gplv3(?: or later| only)?", 0.7),
    ("gpl-3.0", "installation", r"installation information for a user product means any methods procedures authorization keys", 0.9),
    ("lgpl", "received", r"you should have received a copy of the gnu (?:lesser|library) general public license", 0.95),
    ("lgpl", "lesser", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license", 0.95),
    ("lgpl-2.0", "library", r"you can redistribute it and or modify it under the terms of the gnu library general public license", 0.95),
    ("lgpl-2.1-or-later", "later", r"either version 2 1 of the license or (?:at your option )?any later version", 0.9),
    ("lgpl", "lgpl", r"(?:released|licensed|distributed|available|published|covered) under (?:the )?(?:terms of )?(?:the )?(?:gnu )?lgpl", 0.8),
    ("lgpl-2.1", "lgplv2", r"lgplv2(?: 1)?", 0.7),
    ("lgpl-3.0", "lgplv3", r"lgplv3", 0.7),
    ("agpl-3.0", "remotely", r"your modified version must prominently offer all users interacting with it remotely through a computer network", 0.95),
    ("agpl", "received", r"you should have received a copy of the gnu affero general public license", 0.95),
    ("agpl-3.0", "agplv3", r"agplv3", 0.7),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts", 0.95),
    ("gfdl", "document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", 0.95),
    ("classpath-exception", "classpath", r"classpath exception", 0.9),
    ("classpath-exception", "linking", r"linking this library statically or dynamically with other modules is making a combined work based on this library", 0.9),
    ("gcc-exception", "gcc", r"gcc runtime library exception", 0.95),
    ("gcc-exception", "unlimited", r"in addition to the permissions in the gnu general public license .{1,80}? unlimited permission to link the compiled version", 0.9),
    ("linking-exception", "exception", r"as a special exception .{1,100}? give(?:s)? (?:you )?permission to link", 0.85),
    ("font-exception", "font", r"as a special exception if you create a document which uses this font", 0.95),
    ("autoconf-exception", "configuration", r"as a special exception to the gnu general public license if you distribute this file as part of a program that contains a configuration script generated by autoconf", 0.95),
    ("bison-exception", "bison", r"as a special exception you may create a larger work that contains part or all of the bison parser skeleton", 0.95),
    ("openssl-exception", "openssl", r"permission to link .{1,80}? with the openssl library", 0.9),
    ("qt-exception", "qt", r"(?:digia|nokia) qt lgpl exception", 0.9),
    ("linux-syscall-note", "kernel", r"user programs that use kernel services by normal system calls", 0.95),
    ("linux-syscall-note", "syscall", r"linux syscall note", 0.9),
    # file-level copyleft and vendors
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0", 0.95),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1", 0.95),
    ("mpl-1.1", "initial", r"the initial developer of the original code is", 0.7),
    ("mpl-2.0", "incompatible", r"incompatible with secondary licenses as defined by the mozilla public license", 0.9),
    ("cddl-1.0", "development", r"common development and distribution license the license you may not use this file except in compliance", 0.9),
    ("cddl-1.0", "cddl", r"this cddl header must be included", 0.8),
    ("epl-1.0", "accompanying", r"the accompanying program is provided under the terms of this eclipse public license", 0.95),
    ("epl", "eclipse", r"(?:this program and the accompanying materials are )?made available under the terms of the eclipse public license", 0.95),
    ("cpl-1.0", "common", r"the accompanying program is provided under the terms of this common public license", 0.95),
    ("apsl-2.0", "apple", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license", 0.95),
    ("apple-sample", "apple", r"in consideration of your agreement to the following terms and your use installation modification or redistribution of this apple software", 0.95),
    ("ms-pl", "governs", r"this license governs use of the accompanying software if you use the software you accept this license", 0.9),
    ("ms-rsl", "microsoft", r"microsoft reference source license", 0.95),
    ("intel", "intel", r"intel (?:simplified|open source|sample source code) (?:software )?license", 0.9),
    ("oracle-bcl", "oracle", r"oracle binary code license agreement", 0.95),
    ("oracle-nftc", "oracle", r"oracle no fee terms and conditions", 0.95),
    ("sun-sissl", "sun", r"sun industry standards source license", 0.95),
    ("nvidia", "nvidia", r"nvidia (?:software|source code) license(?: agreement)?", 0.9),
    ("amazon-software", "amazon", r"amazon software license", 0.95),
    ("facebook-patent", "patents", r"an additional grant of patent rights can be found in the patents file", 0.95),
    # source-available and model licenses
    ("busl-1.1", "licensor", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", 0.95),
    ("busl-1.1", "change", r"change date .{1,40}? change license", 0.8),
    ("sspl-1.0", "service", r"if you make the functionality of the program or a modified version available to third parties as a service", 0.95),
    ("elastic-2.0", "managed", r"you may not provide the software to third parties as a hosted or managed service", 0.95),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial) license", 0.95),
    ("confluent", "confluent", r"confluent community license", 0.95),
    ("timescale", "timescale", r"timescale license", 0.95),
    ("prosperity", "prosperity", r"prosperity public license", 0.95),
    ("hippocratic", "hippocratic", r"hippocratic license", 0.95),
    ("openrail", "rail", r"open ?rail(?: m| ml)?(?: license)?", 0.8),
    ("openrail", "responsible", r"responsible ai license", 0.9),
    ("llama", "llama", r"llama ?\d?(?: \d)? community license(?: agreement)?", 0.95),
    ("gemma", "gemma", r"gemma terms of use", 0.95),
    # content and data
    ("cc", "commons", r"this work is licensed under (?:a|the) creative commons", 0.9),
    ("cc", "creativecommons", r"creativecommons org licenses by(?: nc)?(?: sa| nd)?", 0.85),
    ("cc0-1.0", "creativecommons", r"creativecommons org publicdomain zero 1 0", 0.9),
    ("cc0-1.0", "waived", r"has (?:dedicated the work to the public domain by waiving|waived) all (?:of his or her rights|copyright and related or neighboring rights)", 0.9),
    ("odbl-1.0", "database", r"made available under the open database license", 0.95),
    ("cdla", "community", r"community data license agreement(?: permissive| sharing)?", 0.95),
    ("cdla", "cdla", r"cdla (?:permissive|sharing) \d \d", 0.95),
    ("ogl-uk", "government", r"open government licen[cs]e", 0.9),
    ("etalab", "etalab", r"licence ouverte(?: open licence)?(?: etalab)?", 0.9),
    ("unlicense", "encumbered", r"this is free and unencumbered software released into the public domain", 0.95),
    ("public-domain", "domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", 0.8),
    ("public-domain", "copyright", r"no copyright is claimed", 0.8),
    ("public-domain", "government", r"work of the (?:u s|us|united states) government", 0.8),
    ("public-domain", "domain", r"public domain", 0.4),
    # notices
    ("warranty-disclaimer", "warranty", r"provided as is without warranty of any kind", 0.5),
    ("warranty-disclaimer", "merchantability", r"implied warranties of merchantability", 0.5),
    ("warranty-disclaimer", "consequential", r"incidental special exemplary or consequential damages", 0.5),
    ("proprietary", "reserved", r"all rights reserved", 0.4),
    ("proprietary", "confidential", r"proprietary and confidential", 0.6),
    ("proprietary", "unauthorized", r"unauthorized copying of this file via any medium is strictly prohibited", 0.9),
    ("proprietary", "reproduced", r"may not be reproduced (?:or transmitted )?in any form", 0.6),
    ("proprietary", "eula", r"end user license agreement(?: eula)?", 0.7),
    ("non-commercial", "commercial", r"(?:for )?non ?commercial (?:use|purposes) only", 0.7),
    ("non-commercial", "research", r"for (?:academic|research|educational)(?: and (?:academic|research|educational))? (?:use|purposes) only", 0.7),
    ("patent-notice", "patents", r"protected by (?:one or more )?(?:u s |us )?patents", 0.5),
    ("trademark-notice", "trademark", r"(?:is a|are) (?:registered )?trademarks? of", 0.4),
    ("copyright-notice", "copyright", r"copyright (?:c )?(?:19|20)\d\d", 0.3),
    ("contributor-agreement", "contributor", r"contributor license agreement", 0.4),
    ("contributor-agreement", "origin", r"developer(?: s|s)? certificate of origin", 0.6),
    ("dual-license", "dual", r"dual licensed", 0.5),
    ("dual-license", "either", r"under either (?:of )?(?:the )?(?:\S+ ){1,6}?or (?:the )?(?:\S+ ){1,4}?licen[cs]e", 0.5),
    ("unknown-license", "license", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:\S+ ){1,3}?license", 0.3),
    ("unknown-license", "licensed", r"licensed under", 0.2),
    ("unknown-license", "license", r"see (?:the )?(?:accompanying )?license(?: txt| md)?(?: file)?(?: for (?:details|more information))?", 0.2),
)

#: A name behind words that grant something is a better detection, which has the longer interval.
_GRANT = r"(?P<grant>(?:released|licensed|distributed|available|provided|covered|governed|published) (?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?)?"


@lru_cache(1)
def rules() -> tuple[Rule, ...]:
    """All rules, highest priority first: tags, license texts, names (each also behind words that grant), weak notices."""
    out = []

    def add(kind: str, label: str, keyword: str, body: str, priority: int, score: float) -> None:
        out.append(Rule(f"{label}/{kind}", label, keyword, re.compile(rf"(?<![^ ])(?:{body})(?![^ ])"), priority, score))

    for label, keyword, name, identifier in LICENSES:
        add("name", label, keyword, f"{_GRANT}(?:{name})", 60, 0.7)
        add("tag", label, "spdx", f"spdx license identifier (?:{identifier})", 100, 1.0)
    for label, keyword, body, score in NOTICES:
        add("notice", label, keyword, body, 70 if score >= 0.8 else 40, score)
    for phrase, label in BASE:
        add("base", label, phrase.split(" ")[0], phrase, 50, 0.6)
    return tuple(sorted(out, key=lambda r: -r.priority))


def _strength(rule: Rule, m: re.Match[str]) -> tuple[int, float]:
    """Priority and score of a match."""
    return (80, 0.9) if m.groupdict().get("grant") else (rule.priority, rule.score)


@lru_cache(1)
def _gate():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for k in sorted({r.keyword for r in rules()}):
        automaton.add_word(k, k)
    automaton.make_automaton()
    return automaton


@dataclass(frozen=True)
class Detection:
    """A rule's match in the words joined by blanks: characters start to end."""

    start: int
    end: int
    rule: Rule
    priority: int
    score: float


def found(joined: str, keywords: set[str]) -> list[Detection]:
    """All matches of the rules whose keyword is there, in the order in which they are taken."""
    out = [Detection(m.start(), m.end(), r, *_strength(r, m)) for r in rules() if r.keyword in keywords for m in r.pattern.finditer(joined)]
    return sorted(out, key=lambda d: (-d.priority, d.start - d.end, d.start, -d.score, d.rule.label, d.rule.name))


def detections(joined: str, keywords: set[str]) -> list[Detection]:
    """The detections that stand, in the order in which they were taken."""
    taken: list[Detection] = []
    reach: list[tuple[int, int]] = []  # the intervals taken, none within another, by start
    for d in found(joined, keywords):
        i = bisect.bisect_right(reach, (d.start, 1 << 62))
        if i and reach[i - 1][1] >= d.end:
            continue
        taken.append(d)
        j = i
        while j < len(reach) and reach[j][1] <= d.end:
            j += 1
        reach[i:j] = [(d.start, d.end)]
    return taken


def scan_text(lowered: str, keywords: set[str]) -> tuple[int, int | None, int | None, str, str, float]:
    """(base places, first and last start, base labels, all labels, score) of a text that has keywords."""
    joined = " ".join(WORD.findall(lowered))
    starts, base = [], set()
    for phrase, label in BASE:
        hits = [m.start() for m in re.finditer(rf"(?<![^ ]){phrase}(?![^ ])", joined)]
        starts += hits
        base |= {label} if hits else set()
    stand = detections(joined, keywords)
    labels = base | {d.rule.label for d in stand}
    first = joined.count(" ", 0, min(starts)) if starts else None
    last = joined.count(" ", 0, max(starts)) if starts else None
    score = max([0.6 if base else 0.0, *(d.score for d in stand)])
    return len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): its number of words, base places, labels and score.

    Null, empty and wordless texts have no words, empty labels and score 0;
    repeated rows each give a row; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate = _gate()
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(1).to_pylist()]
            counts: list[int] = []
            rows = []
            for a, b in W.blocks(raw):
                data, at = W.byte_words(raw[a:b])
                word = _IS_WORD[data]
                begins = word.copy()
                begins[1:] &= ~word[:-1]
                total = np.zeros(len(data) + 1, dtype=np.int64)
                np.cumsum(begins, out=total[1:])
                counts += (total[at[1:]] - total[at[:-1]]).tolist()
                text = data.tobytes()
                for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
                    lowered = text[i:j].decode()
                    held = {k for _, k in gate.iter(lowered)}
                    rows.append(scan_text(lowered, held) if held else (0, None, None, "", "", 0.0))
            columns = list(zip(*rows)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types))],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, _SCHEMA)
