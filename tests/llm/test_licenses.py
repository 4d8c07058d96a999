import pytest

from lumenframe.llm import licenses


@pytest.mark.parametrize(
    ("text", "labels", "score"),
    [
        ("SPDX-License-Identifier: MIT some words SPDX-License-Identifier: GPL-3.0", "gpl,mit", 0.8),
        ("SPDX-License-Identifier: MIT OR SPDX-License-Identifier: Apache-2.0 x SPDX License Identifier AGPL-3.0-only\nISC", "agpl,apache,mit", 0.9),
        ("SPDX-License-Identifier: what SPDX-License-Identifier: MIT", "mit", 0.2),
        ("SPDX-License-Identifier:\nMIT SPDX-License-Identifier: (ISC\r\nand MPL-2.0)", "isc", 0.2),
    ],
)
def test_every_tag_of_a_line_counts(text, labels, score):
    got = licenses.scan(text)
    assert (got[5], got[6]) == (labels, pytest.approx(score))


def test_many_tags_on_a_line():
    text = " ".join(["SPDX-License-Identifier: MIT"] * 20_000 + ["SPDX-License-Identifier: GPL-2.0"])
    assert licenses.scan(text)[5:] == ("gpl,mit", 0.8)
