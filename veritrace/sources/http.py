"""Bodies of URLs. Off unless asked for with authorized=True; tests and replays inject their own transport."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..operators.site import require_authorization

RESOURCE_CAP, TIMEOUT, DELAY = 52_428_800, 20.0, 0.5
AGENT = "veritrace-audit"
FETCHED = "url string, outcome string, body binary, note string"


def inflate(body: bytes, encoding: str, cap: int) -> tuple[bytes, str]:
    """A gzip or deflate body, also a raw one, cut at cap, and a note if it was."""
    if encoding not in ("gzip", "deflate"):
        return body[:cap], "cut at the cap" if len(body) > cap else ""
    for bits in (31,) if encoding == "gzip" else (15, -15):
        try:
            out = zlib.decompressobj(bits).decompress(body, cap + 1)
        except zlib.error:
            continue
        return out[:cap], "inflated body cut at the cap" if len(out) > cap else ""
    raise ValueError(f"malformed {encoding} body")


def plain_transport(url: str, timeout: float, cap: int) -> tuple[bytes, str]:
    """(body, encoding) over http or https; a redirect to another scheme is refused."""
    import urllib.request

    class Same(urllib.request.HTTPRedirectHandler):
        def redirect_request(self, req, fp, code, msg, headers, newurl):
            if not newurl.lower().startswith(("http://", "https://")):
                raise ValueError("redirect to another scheme")
            return super().redirect_request(req, fp, code, msg, headers, newurl)

    ask = urllib.request.Request(url, headers={"User-Agent": AGENT, "Accept-Encoding": "gzip, deflate"})
    with urllib.request.build_opener(Same).open(ask, timeout=timeout) as reply:
        return reply.read(cap + 1), (reply.headers.get("Content-Encoding") or "").lower()


def fetch(urls: DataFrame, authorized: bool = False, transport: Callable[[str, float, int], tuple[bytes, str]] = plain_transport, cap: int = RESOURCE_CAP, timeout: float = TIMEOUT, delay: float = DELAY) -> DataFrame:
    """(url, outcome, body, note) of urls (site, url): outcome ok, timeout or error.

    A site's URLs are fetched by one task, one after the other with delay between; sites in parallel.
    """
    require_authorization(authorized)
    ship(urls.sparkSession)

    def rows(batches: Iterator) -> Iterator:
        import pandas as pd

        last = None
        for batch in batches:
            for url in batch["url"]:
                if last is not None:
                    time.sleep(max(0.0, delay - (time.monotonic() - last)))
                outcome, body, note = "error", None, "scheme refused"
                if url and url.lower().startswith(("http://", "https://")):
                    try:
                        raw, encoding = transport(url, timeout, cap)
                        body, note = inflate(raw, encoding, cap)
                        outcome = "ok"
                    except TimeoutError as e:
                        outcome, note = "timeout", str(e) or "timed out"
                    except Exception as e:  # noqa: BLE001  whatever a server does, the crawl goes on
                        timed = isinstance(getattr(e, "reason", None), TimeoutError)
                        outcome, note = "timeout" if timed else "error", str(e) or type(e).__name__
                last = time.monotonic()
                yield pd.DataFrame([(url, outcome, body, note)], columns=["url", "outcome", "body", "note"])

    return urls.repartition("site").sortWithinPartitions("site").select("url").mapInPandas(rows, FETCHED)


def bodies_as_text(fetched: DataFrame) -> DataFrame:
    from ..operators.routing import decoded

    return fetched.withColumn("html", decoded(F.col("body")))
