"""Whole texts and notices of the common licences, as rows (license_id, text) for ``license_scan.known_digests``."""

from __future__ import annotations

import os
import re

from tableproof.llm.license_scan import KNOWN

_FOLDER = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")

#: Licences and what notices call them, without the article. Names that fit several versions are left out.
NAMES = {
    "MIT": ("MIT License", "MIT", "Expat License"),
    "ISC": ("ISC License", "ISC"),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0", "CC0-1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "Zlib": ("zlib License", "zlib"),
} | {
    f"BSD-{n}-Clause": (f"BSD {n}-Clause License", f"BSD-{n}-Clause License", f"{n}-Clause BSD License", f"BSD-{n}-Clause", f"{old} BSD License")
    for n, old in ((2, "Simplified"), (3, "New"))
} | {
    f"CC-BY{kind}-{v}": (f"CC BY{kind} {v}", f"CC-BY{kind}-{v}", f"Creative Commons Attribution{long} {v} International License" if v == "4.0"
                         else f"Creative Commons Attribution{long} {v} License", f"Creative Commons Attribution{long} {v}")
    for kind, long in (("", ""), ("-SA", "-ShareAlike"), ("-NC", "-NonCommercial"), ("-ND", "-NoDerivatives"),
                       ("-NC-SA", "-NonCommercial-ShareAlike"), ("-NC-ND", "-NonCommercial-NoDerivatives"))
    for v in ("2.0", "2.5", "3.0", "4.0")
}


def _versions(license_id: str, long: str, short: tuple[str, ...], version: str) -> tuple[str, ...]:
    plain = version.removesuffix(".0")
    spoken = {s for v in {version, plain} for s in (f", version {v}", f" version {v}", f" v{v}", f" {v}")}
    return tuple(sorted({long + s for s in spoken} | {f"{x}{s}" for x in short for v in {version, plain} for s in (f"v{v}", f"-{v}", f" v{v}", f" version {v}")} | {license_id}))


for _family, _long, _short, _all in (
    ("Apache", "Apache License", ("Apache",), ("1.1", "2.0")),
    ("GPL", "GNU General Public License", ("GPL", "GNU GPL"), ("1.0", "2.0", "3.0")),
    ("LGPL", "GNU Lesser General Public License", ("LGPL", "GNU LGPL"), ("2.1", "3.0")),
    ("LGPL", "GNU Library General Public License", ("LGPL", "GNU LGPL"), ("2.0",)),
    ("AGPL", "GNU Affero General Public License", ("AGPL", "GNU AGPL"), ("1.0", "3.0")),
    ("GFDL", "GNU Free Documentation License", ("GFDL", "GNU FDL"), ("1.1", "1.2", "1.3")),
    ("MPL", "Mozilla Public License", ("MPL",), ("1.0", "1.1", "2.0")),
    ("EPL", "Eclipse Public License", ("EPL",), ("1.0", "2.0")),
):
    for _v in _all:
        NAMES[f"{_family}-{_v}"] = _versions(f"{_family}-{_v}", _long, _short, _v)
        if _family in ("GPL", "LGPL", "AGPL", "GFDL"):
            NAMES[f"{_family}-{_v}-or-later"] = tuple(
                [f"{x}{later}" for x in NAMES[f"{_family}-{_v}"] for later in (" or later", ", or (at your option) any later version", " or any later version")]
                + [f"{_family}-{_v}+"]
            )

#: Canonical texts know no ``+``, so these names would read as the version alone.
NAMES = {i: tuple(x for x in names if not x.endswith("+")) for i, names in NAMES.items()}

_WHAT = ("", "This work is ", "This project is ", "This software is ", "This program is ", "This file is ", "The code is ")
_HOW = ("Licensed", "Released", "Distributed")
_UNDER = ("under", "under the", "under the terms of the")

#: Headings with which, or without any, a whole text is found.
_HEADINGS = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("", "ISC License", "The ISC License"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'),
    "BSD-3-Clause": ("", "BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'),
    "Unlicense": ("", "The Unlicense", "Unlicense"),
}


def notices() -> list[tuple[str, str]]:
    """Lines that announce a licence: every name in every usual wording."""
    rows = []
    for license_id, names in NAMES.items():
        family = license_id.split("-")[0]
        ids = (license_id, f"{license_id}-only") if family in ("GPL", "LGPL", "AGPL", "GFDL") and "later" not in license_id else (license_id,)
        rows += [(license_id, f"{tag}: {i}") for i in ids for tag in ("SPDX-License-Identifier", "License")]
        rows += [(license_id, f"License: {n}") for n in names]
        rows += [(license_id, f"{what}{how} {under} {n}") for n in names for what in _WHAT for how in _HOW for under in _UNDER]
    # Spellings that differ in punctuation only have one digest.
    return list({re.sub("[^a-z0-9]+", " ", line.lower()).strip(): (i, line) for i, line in reversed(rows)}.values())


def whole_texts() -> list[tuple[str, str]]:
    """Every text of the folder, and MIT and ISC, in the forms in which files carry them."""
    bodies = [(i, text.split("\n\n", 1)[1]) for i, text in KNOWN if i in ("MIT", "ISC") and "\n\n" in text]
    for name in sorted(os.listdir(_FOLDER)):
        with open(os.path.join(_FOLDER, name), encoding="utf-8") as f:
            bodies.append((name.removesuffix(".txt"), f.read()))
    rows = []
    for license_id, body in bodies:
        forms = [body]
        # Some files stop before the advice on how to apply the terms.
        terms, end, advice = body.partition("END OF TERMS AND CONDITIONS")
        if end and advice.strip():
            forms += [terms, terms + end]
        if license_id.startswith("BSD"):
            forms.append(re.sub(r"(?m)^\d\. ", "* ", body))
            forms += [x.replace("COPYRIGHT HOLDER OR CONTRIBUTORS BE", "COPYRIGHT OWNER OR CONTRIBUTORS BE") for x in forms]
        if license_id == "Unlicense":
            forms.append(body.replace("<http://unlicense.org/>", "<https://unlicense.org/>"))
        rows += [(license_id, f"{h}\n\n{x}") for x in forms for h in _HEADINGS.get(license_id, ("",))]
    return rows


def all_known() -> list[tuple[str, str]]:
    return [*KNOWN, *whole_texts(), *notices()]
