"""Licence identifiers of the SPDX list and the notices that name them, as data."""

from __future__ import annotations

#: Identifiers that ask for no more than notice; all else is restricted.
PERMISSIVE = set("""
0BSD AFL-2.0 AFL-2.1 AFL-3.0 Apache Apache-1.0 Apache-1.1 Apache-2.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD BSD-1-Clause BSD-2-Clause
BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSD-Source-Code BSL-1.0 bzip2-1.0.6 CC-BY
CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC0 CC0-1.0 CC-PDDC CNRI-Python curl ECL-2.0 EFL-2.0 FSFAP FTL HPND ICU ISC libpng-2.0 Libpng
MIT MIT-0 MIT-CMU MIT-Modern-Variant MS-PL MulanPSL-2.0 NAIST-2003 NCSA NTP ODC-By-1.0 OFL-1.1 OLDAP-2.8 OpenSSL PDDL-1.0 PHP-3.01 PostgreSQL
PSF-2.0 Python-2.0 Ruby SSH-OpenSSH TCL Unicode-3.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Xnet ZPL-2.1 Zlib zlib-acknowledgement
""".split())

#: Notice (lower case, without commas, one space between words) -> (identifier, whether a version that follows belongs to it).
NOTICES: dict[str, tuple[str, bool]] = {
    "released under the mit license": ("MIT", False),
    "licensed under the mit license": ("MIT", False),
    "distributed under the mit license": ("MIT", False),
    "under the terms of the mit license": ("MIT", False),
    "the mit license (mit)": ("MIT", False),
    "permission is hereby granted free of charge to any person obtaining a copy": ("MIT", False),
    "apache license": ("Apache", True),
    "redistribution and use in source and binary forms": ("BSD", False),
    "licensed under the bsd": ("BSD", False),
    "licensed under the bsd 2-clause": ("BSD-2-Clause", False),
    "licensed under the bsd 3-clause": ("BSD-3-Clause", False),
    "licensed under the bsd-2-clause": ("BSD-2-Clause", False),
    "licensed under the bsd-3-clause": ("BSD-3-Clause", False),
    "permission to use copy modify and/or distribute this software for any purpose": ("ISC", False),
    "permission to use copy modify and distribute this software for any purpose": ("ISC", False),
    "this software is provided 'as-is' without any express or implied warranty": ("Zlib", False),
    "boost software license": ("BSL", True),
    "this is free and unencumbered software released into the public domain": ("Unlicense", False),
    "do what the fuck you want to public license": ("WTFPL", False),
    "sil open font license": ("OFL", True),
    "licensed under cc0": ("CC0", True),
    "cc0 1.0 universal": ("CC0-1.0", False),
    **{f"{lead} {words}": (name, True) for lead in ("licensed under cc", "licensed under a cc", "released under cc") for words, name in (("by", "CC-BY"), ("by-sa", "CC-BY-SA"), ("by-nc", "CC-BY-NC"), ("by-nd", "CC-BY-ND"), ("by-nc-sa", "CC-BY-NC-SA"), ("by-nc-nd", "CC-BY-NC-ND"))},
    **{f"creative commons attribution{words}": (name, True) for words, name in (("", "CC-BY"), ("-sharealike", "CC-BY-SA"), ("-share alike", "CC-BY-SA"), ("-noncommercial", "CC-BY-NC"), ("-noderivs", "CC-BY-ND"), ("-noderivatives", "CC-BY-ND"), ("-noncommercial-sharealike", "CC-BY-NC-SA"), ("-noncommercial-noderivs", "CC-BY-NC-ND"), ("-noncommercial-noderivatives", "CC-BY-NC-ND"))},
    "gnu general public license": ("GPL", True),
    "gnu lesser general public license": ("LGPL", True),
    "gnu library general public license": ("LGPL", True),
    "gnu affero general public license": ("AGPL", True),
    "gnu free documentation license": ("GFDL", True),
    "licensed under the gpl": ("GPL", True),
    "licensed under the lgpl": ("LGPL", True),
    "licensed under the agpl": ("AGPL", True),
    "mozilla public license": ("MPL", True),
    "eclipse public license": ("EPL", True),
    "common development and distribution license": ("CDDL", True),
    "european union public licence": ("EUPL", True),
    "microsoft public license": ("MS-PL", False),
    "server side public license": ("SSPL", True),
    "business source license": ("BUSL", True),
    "all rights reserved": ("PROPRIETARY", False),
}
