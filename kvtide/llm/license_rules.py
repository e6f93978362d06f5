"""The ordered signature rules of the licence scan, as data.

A rule is pinned to one keyword. ``left`` must match the words up to the
keyword, ``right`` the words after it; an empty pattern asks for nothing.
Texts reach the rules as lower-cased words with single blanks, so ``left`` ends
and ``right`` begins with a blank.
"""

from __future__ import annotations

from typing import NamedTuple


#: Words of a signature on either side of its keyword that count; more would be out of the scan's reach.
SIDE = 16


class Rule(NamedTuple):
    keyword: str
    need: str  # literal that the words around the keyword must hold, checked before the patterns
    left: str
    right: str
    label: str
    priority: int  # higher wins
    weight: float  # confidence
    base: bool = False


#: Base phrases of the contract: their places are counted, their labels always stay.
BASE_RULES = [
    Rule("license", "gnu", "gnu general public ", "", "gpl", 0, 0.9, True),
    Rule("license", "apache", "apache ", "", "apache", 0, 0.9, True),
    Rule("cc", "by", "", " by", "cc-by", 0, 0.9, True),
    Rule("license", "mit", "mit ", "", "mit", 0, 0.9, True),
]

#: Label, literal to look for, pattern of the name, pattern of the short identifier.
FAMILIES = [
    ("gpl", "general", "gnu general public", r"gpl(?: \d+)?(?: 0)?(?: (?:only|or later))?"),
    ("lgpl", "lesser", "gnu (?:lesser|library) general public", r"lgpl(?: \d+)?(?: \d+)?(?: (?:only|or later))?"),
    ("agpl", "affero", "(?:gnu )?affero general public", r"agpl(?: \d+)?(?: 0)?(?: (?:only|or later))?"),
    ("fdl", "documentation", "gnu free documentation", r"gfdl(?: 1)?(?: \d)?"),
    ("apache", "apache", "apache(?: software)?", r"apache(?: \d)?(?: \d)?"),
    ("mit", "mit", "mit", "mit"),
    ("mit-0", "attribution", "mit no attribution", "mit 0"),
    ("x11", "x11", "x11", "x11"),
    ("bsd", "bsd", r"(?:(?:new|revised|modified|simplified|original) )?(?:\d clause )?bsd", r"bsd(?: \d clause)?"),
    ("0bsd", "zero", "zero clause bsd", "0bsd"),
    ("isc", "isc", "isc", "isc"),
    ("mpl", "mozilla", "mozilla public", r"mpl(?: \d)?(?: \d)?"),
    ("epl", "eclipse", "eclipse public", r"epl(?: \d)?(?: \d)?"),
    ("cddl", "distribution", "common development and distribution", r"cddl(?: 1)?(?: \d)?"),
    ("cpl", "common", "common public", "cpl(?: 1)?(?: 0)?"),
    ("ipl", "ibm", "ibm public", "ipl(?: 1)?(?: 0)?"),
    ("eupl", "european", "european union public", r"eupl(?: 1)?(?: \d)?"),
    ("artistic", "artistic", "artistic", r"artistic(?: \d)?(?: 0)?"),
    ("boost", "boost", "boost software", "bsl(?: 1)?(?: 0)?"),
    ("zlib", "zlib", "zlib", "zlib"),
    ("libpng", "libpng", "libpng", "libpng(?: 2)?(?: 0)?"),
    ("unlicense", "unlicense", "the unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "(?:do what the fuck you want to public|wtfpl)", "wtfpl"),
    ("python", "python", "python(?: software foundation)?", r"(?:psf|python)(?: \d)?(?: \d)?"),
    ("php", "php", "php", r"php(?: 3)?(?: \d+)?"),
    ("ruby", "ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("ofl", "font", "(?:sil )?open font", r"ofl(?: 1)?(?: \d)?"),
    ("odbl", "database", "open (?:data commons )?(?:open )?database", "odbl(?: 1)?(?: 0)?"),
    ("odc-by", "attribution", "open data commons attribution", "odc by(?: 1)?(?: 0)?"),
    ("ogl", "government", "open government", r"ogl(?: uk)?(?: \d)?(?: 0)?"),
    ("ms-pl", "microsoft", "microsoft public", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal", "ms rl"),
    ("afl", "academic", "academic free", r"afl(?: \d)?(?: \d)?"),
    ("osl", "open", "open software", r"osl(?: \d)?(?: \d)?"),
    ("bsl", "business", "business source", "busl(?: 1)?(?: 1)?"),
    ("sspl", "server", "server side public", "sspl(?: 1)?(?: 0)?"),
    ("elastic", "elastic", "elastic", "elastic(?: 2)?(?: 0)?"),
    ("vim", "vim", "vim", "vim"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
]

VERB = "(?:licensed|licenced|released|distributed|published|available|provided|issued|offered|covered)"

#: Creative Commons elements after "by", label.
CC = [("", "cc-by"), (" sa", "cc-by-sa"), (" nc", "cc-by-nc"), (" nd", "cc-by-nd"), (" nc sa", "cc-by-nc-sa"), (" nc nd", "cc-by-nc-nd")]

#: Notices that name no family.
NOTICES = [
    Rule("reserved", "rights", "all rights ", "", "all-rights-reserved", 20, 0.6),
    Rule("copyright", "reserved", "", r"(?: \S+){1,8} all rights reserved", "all-rights-reserved", 30, 0.8),
    Rule("copyright", "", "", r"(?: c)? (?:19|20)\d\d", "copyright-notice", 10, 0.4),
    Rule("domain", "public", "(?:released into|dedicated to|in|placed in|donated to) the public ", "", "public-domain", 40, 0.8),
    Rule("domain", "public", "public ", " dedication", "public-domain", 45, 0.9),
    Rule("permission", "hereby", "", " is hereby granted free of charge to any person", "mit", 60, 0.95),
    Rule("permission", "use", "", " to use copy modify and(?: or)? distribute this software", "isc", 60, 0.95),
    Rule("redistribution", "source", "", " and use in source and binary forms", "bsd", 60, 0.95),
    Rule("warranty", "without", "without (?:any )?", "(?: of any kind)?", "no-warranty", 5, 0.3),
    Rule("copyleft", "", "", "", "copyleft", 5, 0.4),
    Rule("proprietary", "confidential", "", " and confidential", "proprietary", 40, 0.8),
    Rule("proprietary", "confidential", "confidential and ", "", "proprietary", 40, 0.8),
    Rule("cc0", "", "", r"(?: 1 0)?", "cc0", 50, 0.9),
    Rule("creativecommons", "publicdomain", "", " org publicdomain zero(?: 1 0)?", "cc0", 70, 0.95),
    Rule("unlicense", "", "", "", "unlicense", 40, 0.8),
    Rule("wtfpl", "", "", "", "wtfpl", 40, 0.8),
]

#: Signatures: sentences of the licenses' own texts, preambles, clauses, disclaimers and headers. The keyword is the longest word, as long words are rare, or the one in brackets.
SIGNATURES: dict[str, list[str]] = {
    "gpl": [
        "everyone is [permitted] to copy and distribute verbatim copies of this license document but changing it is not allowed",
        "the licenses for most software are designed to take away your freedom to share and change it",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "without even the implied [warranty] of merchantability or fitness for a particular purpose see the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
        "when we speak of free software we are referring to freedom not price",
        "you must cause the modified files to carry prominent notices stating that you changed the files",
        "activities other than copying distribution and modification are not covered by this license",
        "the source code for a work means the preferred form of the work for making modifications to it",
        "mere aggregation of another work not based on the program",
        "you may not propagate or modify a covered work except as expressly provided under this license",
        "to convey a work means any kind of propagation that enables other parties to make or receive copies",
        "the corresponding source for a work in object code form means all the source code needed to generate install",
        "no covered work shall be deemed part of an effective technological measure",
        "each time you convey a covered work the recipient automatically receives a license from the original [licensors]",
        "the gnu general public license does not permit incorporating your program into [proprietary] programs",
        "a user product is either a consumer product",
        "if the program does not specify a version number of this license you may choose any version ever published",
    ],
    "lgpl": [
        "is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "is free software you can redistribute it and or modify it under the terms of the gnu library general public license",
        "this license the lesser general public license applies to some specially designated [software] packages",
        "a program that contains no derivative of any portion of the library but is designed to work with the library",
        "a combined work is a work produced by combining or linking an application with the library",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "we call this license the lesser general public license because it does less to [protect] the user",
        "the object code form of an application may incorporate material from a header file that is part of the library",
    ],
    "agpl": [
        "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "specifically to ensure [cooperation] with the community in the case of network server software",
        "your modified version must prominently offer all users [interacting] with it remotely through a computer network",
        "you should have received a copy of the gnu affero general public license along with this program",
    ],
    "fdl": [
        "[permission] is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",
        "with no invariant sections no front cover texts and no back cover texts",
        "the purpose of this license is to make a manual [textbook] or other functional and useful document free",
        "a secondary section is a named [appendix] or a front matter section of the document",
    ],
    "apache": [
        "you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www apache org licenses license 2 0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        "see the license for the specific language governing permissions and limitations under the license",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
        "see the notice file distributed with this work for additional information regarding copyright ownership",
        "terms and conditions for use reproduction and distribution",
        "each contributor hereby grants to you a [perpetual] worldwide non exclusive no charge royalty free irrevocable copyright license",
        "if the work includes a notice text file as part of its distribution",
        "you must cause any modified files to carry prominent notices stating that you changed the files",
        "this license does not grant permission to use the trade names [trademarks] service marks or product names of the licensor",
        "this product includes software developed by the apache software foundation http www apache org",
        "the end user documentation included with the redistribution if any must include the following acknowledgment",
    ],
    "mit": [
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute",
        "and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "[permission] is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability",
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software",
        "merchantability fitness for a particular purpose and [noninfringement] in no event shall the authors",
    ],
    "mit-0": ["to permit persons to whom the software is furnished to do so the software is provided as is"],
    "x11": [
        "except as contained in this notice the name of the x [consortium] shall not be used in advertising",
        "in no event shall the x consortium be liable for any claim damages or other liability",
        "x window system is a [trademark] of x consortium inc",
        "without fee is hereby granted provided that the above copyright notice appear in all copies and that both that",
    ],
    "bsd": [
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must [reproduce] the above copyright notice this list of conditions and the following disclaimer",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
        "neither the name of the university nor the names of its contributors may be used to endorse or promote products",
        "all [advertising] materials mentioning features or use of this software must display the following acknowledgement",
        "this software is provided by the copyright holders and contributors as is and any express or implied [warranties]",
        "this software is provided by the regents and contributors as is and any express or implied [warranties]",
        "this product includes software developed by the university of california [berkeley] and its contributors",
        "in no event shall the regents or contributors be liable for any direct indirect incidental special exemplary",
        "[procurement] of substitute goods or services loss of use data or profits or business interruption",
        "the views and conclusions contained in the software and documentation are those of the authors and should not be [interpreted]",
        "no express or implied licenses to any party s patent rights are granted by this license",
    ],
    "0bsd": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software"],
    "isc": [
        "the author [disclaims] all warranties with regard to this software including all implied warranties of merchantability",
        "loss of use data or profits whether in an action of contract negligence or other tortious action",
        "isc [disclaims] all warranties with regard to this software",
        "internet systems consortium inc isc",
    ],
    "mpl": [
        "this source code form is subject to the terms of the [mozilla] public license v 2 0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
        "the contents of this file are subject to the mozilla public license version 1 1",
        "the initial developer of the [original] code is",
        "alternatively the contents of this file may be used under the terms of either the gnu general public license version",
        "if you wish to allow use of your version of this file only under the terms of either the [gpl] or the lgpl",
        "this source code form is incompatible with [secondary] licenses as defined by the mozilla public license",
        "covered [software] means source code form to which the initial contributor has attached the notice in exhibit a",
    ],
    "epl": [
        "this program and the accompanying [materials] are made available under the terms of the eclipse public license",
        "the accompanying materials are made available under the terms of the eclipse public license v 1 0 which [accompanies] this distribution",
        "any use reproduction or distribution of the program constitutes [recipient] s acceptance of this agreement",
        "secondary [licenses] when the conditions for such availability set forth in the eclipse public license",
    ],
    "cddl": [
        "the contents of this file are subject to the terms of the common development and distribution license",
        "when distributing covered code include this cddl header in each file",
        "you can obtain a copy of the license at usr src opensolaris license",
        "see the license for the specific language governing permissions and limitations under the license when distributing covered code",
    ],
    "cpl": ["the accompanying program is provided under the terms of this common public license agreement"],
    "eupl": [
        "licensed under the eupl version 1 1 or as soon they will be approved by the european commission",
        "licensed under the eupl version 1 2 or as soon they will be approved by the european commission",
        "this european union public licence the eupl applies to the work as defined below which is provided under the terms of this licence",
    ],
    "artistic": [
        "the intent of this document is to state the conditions under which a package may be copied",
        "you may make and give away verbatim copies of the source form of the standard version of this package",
        "this library is free software you can redistribute it and or modify it under the same terms as perl itself",
        "you are permitted to use the standard version and create and use modified versions for any purpose without restriction",
    ],
    "boost": [
        "distributed under the boost software license version 1 0",
        "see accompanying file license 1 0 txt or copy at http www boost org license 1 0 txt",
        "the copyright notices in the software and this entire statement including the above license grant this restriction",
        "unless such copies or derivative works are solely in the form of machine [executable] object code",
    ],
    "zlib": [
        "this software is provided as is without any express or implied [warranty] in no event will the authors be held liable",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
        "this notice may not be removed or altered from any source distribution",
        "[permission] is granted to anyone to use this software for any purpose including commercial applications",
    ],
    "libpng": [
        "the contributing authors and group 42 inc [disclaim] all warranties expressed or implied",
        "the png reference library is supplied as is the contributing authors and group 42 inc [disclaim] all warranties",
        "this copyright notice may not be removed or altered from any source or altered source distribution",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software",
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest",
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
    ],
    "wtfpl": ["everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", "you just do what the [fuck] you want to"],
    "python": [
        "this license agreement is between the python software [foundation] psf and the individual or organization licensee",
        "psf is making python available to licensee on an as is basis",
        "beopen com hereby grants licensee a non exclusive royalty free world wide license",
        "cnri is making python 1 6 1 available to licensee on an as is basis",
    ],
    "php": ["this product includes php software freely available from http www php net software", "products derived from this software may not be called php nor may php appear in their name"],
    "ruby": ["you may modify your copy of the software in any way provided that you do at least one of the following", "place your modifications in the public domain or otherwise make them freely [available]"],
    "openssl": [
        "this product includes software developed by the openssl project for use in the openssl toolkit",
        "this product includes cryptographic software written by eric young",
        "the names openssl toolkit and openssl project must not be used to endorse or promote products",
    ],
    "ofl": [
        "this font software is licensed under the sil open font license version 1 1",
        "no modified version of the font software may use the reserved font name",
        "the fonts may be bundled embedded redistributed and or sold with any software",
        "neither the font software nor any of its individual components in original or modified versions may be sold by itself",
        "to stimulate worldwide development of collaborative font projects",
    ],
    "odbl": ["this data [database] is made available under the open database license", "any rights in individual contents of the database are licensed under the database [contents] license", "if you alter transform or build upon this database you may distribute the [resulting] database only under"],
    "ogl": ["contains public sector information licensed under the open government licence", "you are free to copy publish distribute and transmit the information"],
    "ms-pl": ["if you use the software you accept this license if you do not accept the license do not use the software", "if you bring a patent claim against any contributor over patents that you claim are infringed by the software"],
    "ms-rl": ["for any file you distribute that contains code from the software in source code or binary format you must provide [recipients] the source code"],
    "afl": ["licensed under the [academic] free license version"],
    "osl": ["licensed under the open software license version 3 0 [external] deployment"],
    "bsl": ["the licensor hereby grants you the right to copy modify create derivative works redistribute and make non [production] use", "effective on the change date or the fourth anniversary of the first publicly available distribution", "additional use grant you may make use of the licensed work"],
    "sspl": ["if you make the functionality of the program or a modified version available to third parties as a service", "you must make the service source code available via network download to everyone at no charge"],
    "elastic": ["you may not provide the software to third parties as a hosted or managed service", "you may not move change disable or [circumvent] the license key functionality in the software"],
    "commons-clause": ["the license does not grant to you the right to sell the software", "the software is provided to you by the [licensor] under the license as defined below subject to the following condition"],
    "vim": ["vim is charityware you can use and copy it as much as you like", "you are encouraged to make a [donation] for needy children in uganda"],
    "postgresql": ["in no event shall the university of california be liable to any party for direct indirect special incidental", "portions copyright c 1994 the regents of the university of california"],
    "curl": ["except as contained in this notice the name of a copyright holder shall not be used in advertising"],
    "ncsa": ["developed by the university of illinois at urbana champaign", "redistributions of source code must retain the above copyright notice this list of conditions and the following [disclaimers]"],
    "upl": ["each a larger work to which the software is contributed by such licensors", "the universal permissive license upl version 1 0"],
    "json": ["the software shall be used for good not evil"],
    "beerware": ["as long as you retain this notice you can do whatever you want with this stuff", "if we meet some day and you think this stuff is worth it you can buy me a [beer]"],
    "hippocratic": ["the software may not be used by individuals corporations governments or other groups for systems or activities that actively and [knowingly]"],
    "cc0": [
        "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights",
        "to the extent possible under law the author s have dedicated all [copyright] and related and neighboring rights",
        "[affirmer] hereby overtly fully permanently irrevocably and unconditionally waives",
    ],
    "cc-by": ["you must give appropriate credit provide a link to the license and indicate if changes were made", "you are free to share copy and redistribute the material in any medium or format"],
    "cc-by-sa": ["if you remix transform or build upon the material you must [distribute] your contributions under the same license as the original"],
    "cc-by-nc": ["you may not use the material for commercial purposes", "in any manner that is primarily intended for or directed toward [commercial] advantage or private monetary compensation"],
    "cc-by-nd": ["if you remix transform or build upon the material you may not distribute the [modified] material"],
    "proprietary": [
        "this software is the confidential and proprietary information of",
        "you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement",
        "unauthorized copying of this file via any medium is strictly prohibited",
        "no part of this publication may be [reproduced] stored in a retrieval system or transmitted in any form",
        "all information contained herein is and remains the [property] of",
        "dissemination of this information or reproduction of this material is strictly [forbidden] unless prior written permission is obtained",
        "this material may not be published broadcast [rewritten] or redistributed",
        "by installing copying or otherwise using the software you agree to be bound by the terms",
        "you may not reverse engineer [decompile] or disassemble the software",
        "no license express or implied by [estoppel] or otherwise to any intellectual property rights is granted",
    ],
    "government-rights": ["use duplication or disclosure by the government is subject to restrictions as set forth in subparagraph", "this work was created by an employee of the united states government and is in the public domain"],
    "no-warranty": ["the entire risk as to the quality and performance of the program is with you", "there is no [warranty] for the program to the extent permitted by applicable law", "the software is provided as is without [warranty] of any kind express or implied"],
}


def _signature(label: str, sentence: str) -> Rule:
    """A sentence as a rule, pinned to its keyword. The literal to look for is its longest other word within reach."""
    words = sentence.split()
    at = next((k for k, w in enumerate(words) if w[0] == "["), None)
    at = words.index(max(words, key=len)) if at is None else at
    left, right = words[max(0, at - SIDE) : at], words[at + 1 : at + 1 + SIDE]
    need = max(left + right, key=len)
    return Rule(words[at].strip("[]"), need, "".join(w + " " for w in left), "".join(" " + w for w in right), label, 65, 0.97)


def rules() -> list[Rule]:
    """All rules: the base phrases first, then families by template, Creative Commons by element, notices, signatures."""
    out = list(BASE_RULES)
    for word in ("license", "licence"):
        for label, need, name, _ in FAMILIES:
            out.append(Rule(word, need, f"(?:the |an |a )?{name} ", "", label, 50, 0.8))
            out.append(Rule(word, need, f"(?:the |an |a )?{name} ", r"(?: version| v)? v?\d+(?: \d+){0,2}(?: only| or(?: any)? later(?: version)?)?", label, 60, 0.95))
    for label, need, name, short in FAMILIES:
        for word in ("license", "licence"):
            out.append(Rule(word, need, rf"{VERB} under (?:the |an |a )?(?:terms of (?:the |an |a )?)?{name} ", r"(?: version)?(?: v?\d+){0,3}(?: only| or(?: any)? later(?: version)?)?", label, 80, 1.0))
        out.append(Rule("licensed", "under", "", rf" under (?:the |an |a )?{short}(?= |$)", label, 55, 0.85))
        out.append(Rule("spdx", "identifier", "", rf" license identifier {short}", label, 90, 1.0))
        out.append(Rule("opensource", "licenses", "", rf" org licenses {short}", label, 70, 0.95))
    for element, label in CC:
        out.append(Rule("cc", "by", "", rf" by{element}(?: (?:international|unported))?", label, 50 + len(element), 0.9))
        out.append(Rule("cc", "by", "", rf" by{element} \d \d(?: (?:international|unported|[a-z][a-z]))?", label, 60 + len(element), 0.95))
        out.append(Rule("cc", "by", rf"{VERB} under (?:a |the )?", rf" by{element}(?: \d \d)?", label, 80 + len(element), 1.0))
        out.append(Rule("creativecommons", "licenses", "", rf" org licenses by{element}(?: \d \d)?", label, 90 + len(element), 1.0))
    for words, label in (("attribution", "cc-by"), ("attribution share ?alike", "cc-by-sa"), ("attribution non ?commercial", "cc-by-nc"), ("attribution no ?deriv(?:ative)?s", "cc-by-nd")):
        out.append(Rule("commons", "creative", "creative ", rf" {words}(?: \d \d)?(?: international| unported)?(?: licen[cs]e)?", label, 60 + len(words), 0.95))
    return out + NOTICES + [_signature(label, x) for label, sentences in SIGNATURES.items() for x in sentences]
