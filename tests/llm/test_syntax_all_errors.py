"""Every error of a long file is reported, however many there are."""

import pytest

from shelfmark.llm.syntax import errors_of


@pytest.mark.parametrize(
    "language, line",
    [("javascript", "x = (1 + ];\n"), ("java", "class A { int x = (1 + ]; }\n"), ("ruby", "x = 1 2\n")],
)
def test_all_errors_of_a_long_file(language, line):
    once = len(errors_of(language, line))
    assert once >= 1
    assert len({n for n, _ in errors_of(language, line * 600)}) == 600


def test_all_errors_of_a_long_json_list():
    assert len(errors_of("json", "[\n" + "{1: 2},\n" * 600 + "3]")) == 600
