"""Licence texts as source files carry them."""

import pytest

from quern.llm import licenses

MIT = """Copyright (c) 2024 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies."""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version."""
BSD = """Neither the name of the copyright holder nor the names of its contributors
may be used to endorse or promote products derived from this software
without specific prior written permission."""
UNLICENSE = "This is free and unencumbered software released into the public domain."


@pytest.mark.parametrize("name, text", [("MIT", MIT), ("ISC", ISC), ("LGPL-2.1", LGPL), ("BSD-3-Clause", BSD), ("Unlicense", UNLICENSE)])
def test_standard_texts_are_found(name, text):
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    for body in (text, "\n".join("# " + x if x else x for x in text.split("\n"))):
        assert name in {n for unit in licenses.units(body) for n, _, _ in known.of(unit)}


@pytest.mark.parametrize("name", sorted(licenses.WHOLE))
def test_whole_licences_in_longer_texts(name):
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    of = lambda text: {known.all[i][1] for i in known.within(licenses.words(text))}
    parts = licenses.WHOLE[name]
    assert name in of("alpha beta gamma " * 30 + " Copyright 2024 Jane Doe. " + "\n\n * ".join(parts) + " See the file for details. " + "delta " * 50)
    assert not of("alpha beta gamma " * 200) and not of("")


def test_notices_within_longer_lines():
    known = licenses.Templates(licenses.TEMPLATES, licenses.THRESHOLD)
    of = lambda text: {known.all[i][1] for i in known.within(licenses.words(text))}
    gpl = licenses.TEMPLATES["GPL-3.0"][0]
    assert of(f"Copyright 2024 Jane Doe. {gpl} See LICENSE for details.") == {"GPL-3.0"}
    assert of(f"{gpl.replace('work', 'whole work')} {'x ' * 500}") == {"GPL-3.0"}
