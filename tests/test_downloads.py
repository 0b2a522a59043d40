import json

import pytest

from terroir.sources import downloads, files

BODY = bytes(range(256)) * 40


def flaky(body, breaks, ranges=True):
    """A service whose connection breaks after so many bytes, once for each number."""
    asked, todo = [], list(breaks)

    def fetch(url, start):
        asked.append(start)
        begin = start if ranges else 0

        def chunks():
            stop = begin + todo.pop(0) if todo else None
            for k in range(begin, len(body) if stop is None else stop, 100):
                yield body[k : min(k + 100, stop or len(body))]
            if stop is not None:
                raise ConnectionError("broken")

        return ranges and start > 0, chunks()

    return fetch, asked


def test_a_broken_download_resumes(tmp_path):
    fetch, asked = flaky(BODY, [1000, 2500])
    assert downloads.download(fetch, "u", str(tmp_path / "f"), pause=0) == len(BODY) and (tmp_path / "f").read_bytes() == BODY
    assert asked == [0, 1000, 3500] and not (tmp_path / "f.part").exists()
    fetch, asked = flaky(BODY, [1000], ranges=False)  # a service without ranges starts again
    assert downloads.download(fetch, "u", str(tmp_path / "g"), pause=0) == len(BODY) and (tmp_path / "g").read_bytes() == BODY
    with pytest.raises(OSError):
        downloads.download(flaky(BODY, [10] * 9)[0], "u", str(tmp_path / "h"), attempts=3, pause=0)
    assert not (tmp_path / "h").exists()


def test_polygons_are_fetched_once(tmp_path):
    body = json.dumps({"type": "FeatureCollection", "features": [{}, {}]}).encode()
    fetch, asked = flaky(body, [])
    assert [downloads.fetch_polygons(fetch, "u", str(tmp_path / "p.json")) for _ in range(2)] == [2, 2] and asked == [0]
    for bad in (b"<html>", b'{"type": "FeatureCollection", "features": []}', b"[1]"):
        with pytest.raises(ValueError):
            downloads.fetch_polygons(flaky(bad, [])[0], "u", str(tmp_path / "q.json"))
        assert not (tmp_path / "q.json").exists()
    assert "code_insee+IN+%28%2796007%27%2C+%2700356%27%29" in downloads.polygon_url("https://x", "l", ["96007", "00356"])
    with pytest.raises(ValueError):
        downloads.polygon_url("https://x", "l", [])


def test_editions():
    assert files.historical_years() == (2016, 2017, 2018, 2019, 2020)
    assert files.vintage_url(2020, files.EDITIONS, "b") == "b/202504/valeursfoncieres-2020.txt.zip"
