"""Reading ranges of files without Spark."""

import re

import pytest

from logwarden.sources.hidden import opened, range_lines


@pytest.mark.parametrize("name", ["_a.log", "_a b#%20?.log", "_x:/y.log", "_é.log"])
@pytest.mark.parametrize("form", ["file:{}", "file://{}", "{}"])
def test_paths_as_hadoop_writes_them(tmp_path, name, form):
    path = tmp_path / name
    path.parent.mkdir(exist_ok=True)
    path.write_bytes(b"one\ntwo")
    with opened(form.format(path)) as source:
        assert source.read() == b"one\ntwo"


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_ranges_give_every_line_once(tmp_path, size, monkeypatch):
    import logwarden.sources.hidden as H

    monkeypatch.setattr(H, "AHEAD", 2)
    data = b"\n\r\n\rone\r\ntwo\rthree\n\n\xff\xfe four\r\r\nfive" + b"x" * 30
    path = tmp_path / "_f"
    for text in (data, data + b"\n", data + b"\r", data + b"\r\n", b"", b"\n", b"\r\n"):
        path.write_bytes(text)
        want = re.split(rb"\r\n|\r|\n", text)
        want = want[:-1] if not want[-1] else want  # no line behind the last end
        with opened(str(path)) as source:
            got = [line for a in range(0, len(text), size) for line in range_lines(source, a, a + size)]
        assert got == want, (text, size)
