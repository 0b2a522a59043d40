"""Downloads that resume, and the polygon service. The transport is injected: nothing here opens a connection of its own."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable, Sequence
from pathlib import Path
from urllib.parse import urlencode

#: A fetch: (url, first byte wanted) -> (whether the answer starts there, its chunks). It raises OSError when the connection fails.
Fetch = Callable[[str, int], tuple[bool, Iterable[bytes]]]


def download(fetch: Fetch, url: str, target: str, attempts: int = 5, pause: float = 5.0) -> int:
    """Bytes of the file once it is whole. A broken connection is taken up where it broke, if the service can, else from the start; after the last attempt
    the error is raised. The file is named ``<target>.part`` until then, so nobody reads a part of it."""
    part, place = Path(f"{target}.part"), Path(target)
    for left in reversed(range(attempts)):
        have = part.stat().st_size if part.exists() else 0
        try:
            resumed, chunks = fetch(url, have)
            with part.open("ab" if have and resumed else "wb") as out:
                for chunk in chunks:
                    out.write(chunk)
            part.replace(place)
            return place.stat().st_size
        except OSError:
            if not left:
                raise
            time.sleep(pause)
    raise ValueError("at least one attempt is needed")


def http_fetch(url: str, start: int) -> tuple[bool, Iterable[bytes]]:
    """The fetch over HTTP, by byte ranges."""
    from urllib.request import Request, urlopen

    answer = urlopen(Request(url, headers={"Range": f"bytes={start}-"} if start else {}), timeout=60)

    def chunks():
        with answer:
            while piece := answer.read(1 << 20):
                yield piece

    return answer.status == 206, chunks()


def polygon_url(base: str, layer: str, codes: Sequence[str], field: str = "code_insee") -> str:
    """Address of the polygons of some towns at a feature service, as GeoJSON in degrees; no codes is an error, as it would ask for everything."""
    if not codes:
        raise ValueError("at least one town code is needed")
    listed = ", ".join("'" + c.replace("'", "''") + "'" for c in codes)
    asked = {"SERVICE": "WFS", "VERSION": "2.0.0", "REQUEST": "GetFeature", "TYPENAMES": layer, "OUTPUTFORMAT": "application/json", "SRSNAME": "urn:ogc:def:crs:EPSG::4326", "CQL_FILTER": f"{field} IN ({listed})"}
    return f"{base}?{urlencode(asked)}"


def fetch_polygons(fetch: Fetch, url: str, target: str, **how) -> int:
    """Number of features of the collection at the place, fetched only if it is not there yet. An answer that is no collection with features raises and leaves
    nothing behind."""
    place = Path(target)
    if not place.exists() or not place.stat().st_size:
        fresh = Path(f"{target}.new")
        download(fetch, url, str(fresh), **how)
        try:
            body = json.loads(fresh.read_text(encoding="utf-8"))
            good = isinstance(body, dict) and body.get("type") == "FeatureCollection" and body.get("features")
        except ValueError:
            good = False
        if not good:
            fresh.unlink()
            raise ValueError("the service gave no collection of features")
        fresh.replace(place)
    return len(json.loads(place.read_text(encoding="utf-8"))["features"])
