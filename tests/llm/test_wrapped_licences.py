"""Licence texts that are wrapped over lines."""

import textwrap

import pytest

from lexgrove.llm import licenses

TEXTS = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "apache": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}


@pytest.mark.parametrize("family", TEXTS)
@pytest.mark.parametrize("width", [40, 60, 78])
def test_wrapped_texts_are_confirmed(family, width):
    text = "Some words.\n\n" + "\n".join(" * " + x for x in textwrap.wrap(TEXTS[family], width)) + "\n\nOther words.\n"
    n, found = licenses.model().paragraphs(text)
    assert n == 2 + len(textwrap.wrap(TEXTS[family], width))
    assert {f for _, f, *_, ok in found if ok} == {family}


def test_the_frame_of_a_notice_confirms_no_family():
    text = "Use of this source code is governed by the Foo licence\nthat can be found in the LICENSE file."
    assert not any(ok for *_, ok in licenses.model().paragraphs(text.replace("\n", " "))[1])


@pytest.mark.parametrize("text", [
    "Licensed under the Eclipse Public License 2.0.", "Distributed under the Boost Software License 1.0.", "Released under the ISC License.", "Published under the Sleepycat License, version 2.0.",
    "This program is licensed under the Zope Public License 2.1.", "Licensed under the Mulan Permissive Software License, Version 2.", "The The The The The The", "Of Of Of Of Of Of Of Of", "public public license license 2.0 2.0",
    "Apache helicopters flew over the city on Monday, and the pilots were at MIT.", "He lost his driver's license in May.",
])
def test_other_licences_and_other_text_are_not_confirmed(text):
    n, found = licenses.model().paragraphs(text)
    assert n == 1 and not any(ok for *_, ok in found), found


@pytest.mark.parametrize(("text", "family"), [
    ("Dual use permitted; covered by the Apache License, Version 2.0 (see NOTICE).", "apache"), ("The samples are, unlike the book, released under the MIT License.", "mit"), ("Our fonts aside, everything here is available under the BSD 3-Clause License!", "bsd"),
    ("Documentation is licensed under CC BY-SA 4.0 unless noted.", "cc-by-sa"), ("Photos: licensed under CC BY 4.0, thanks to all authors.", "cc-by"), ("The tables are in the public domain; released under CC0 1.0.", "cc0"),
    ("You can use it under the GNU Lesser General Public License, version 3, or buy a licence.", "lgpl"), ("The server is under the GNU Affero General Public License, version 3.", "agpl"), ("This file is covered by the Mozilla Public License, Version 2.0.", "mpl"),
])
def test_notices_that_no_template_has_are_confirmed(text, family):
    assert [f for _, f, *_, ok in licenses.model().paragraphs(text)[1] if ok] == [family]


def test_repeated_words_name_nothing():
    m = licenses.model()
    assert not [x for w in ("the", "of", "license", "mit", "public") for k in (3, 9, 30) for x in m.paragraphs(" ".join([w] * k))[1] if x[4]]
    assert 0.5 <= m.threshold < 1


GRANTS = {
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "boost": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software',
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
}


@pytest.mark.parametrize("width", [1, 40, 70, 3000])
@pytest.mark.parametrize("family", ["mit", *GRANTS])
def test_grants_at_any_wrapping(family, width):
    words = (GRANTS | TEXTS)[family]
    text = "\n".join(textwrap.wrap(words, width) if width > 1 else words.split())
    m = licenses.model()
    found = [(f, p) for _, f, p, _, ok in m.paragraphs("Some words.\n\n" + text)[1] if ok]
    assert {f for f, _ in found} == ({family} if family in m.families else set())
    assert all(p >= m.threshold for _, p in found)
