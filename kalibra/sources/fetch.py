"""SRC19: pages fetched by tasks, with retries, growing waits and a record of each attempt."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Answers that may change when asked again.
PASSING = {408, 425, 429, 500, 502, 503, 504}
ATTEMPT = pa.struct([("status", pa.int32()), ("error", pa.string()), ("waited", pa.float64())])


def asked(url: str, timeout: float, headers: dict[str, str]) -> tuple[int | None, str | None, str | None]:
    """(status, error, text) of one attempt."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as answer:
            return answer.status, None, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        e.close()
        return e.code, str(e.reason), None
    except (OSError, ValueError, LookupError) as e:  # no connection, time out, no address, no such charset
        return None, f"{type(e).__name__}: {e}", None


def fetched(urls: DataFrame, key: str, url: str, tries: int = 4, wait: float = 1.0, timeout: float = 30.0, tasks: int | None = None, headers: dict[str, str] | None = None) -> DataFrame:
    """(key, url, status, html, attempts): a row for each row of urls.

    Attempts that fail in passing are repeated after wait, twice wait, four times
    wait and so on; others, and null addresses, are not.  html is null where none
    succeeded; status is that of the last answer, null without any.  Rows are dealt
    out to tasks, each of which asks one page at a time, so tasks bounds the load.
    A lost task asks again: fetching has to be repeatable.
    """
    kind = urls.schema[key].dataType.simpleString()
    sent = dict(headers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, address in enumerate(b.column(1).to_pylist()):
                attempts, status, html = [], None, None
                for n in range(tries if address is not None else 0):
                    waited = wait * 2 ** (n - 1) if n else 0.0
                    time.sleep(waited)
                    status, error, html = asked(address, timeout, sent)
                    attempts.append({"status": status, "error": error, "waited": waited})
                    if html is not None or (status is not None and status not in PASSING):
                        break
                arrays = [b.column(0).slice(i, 1), pa.array([address], pa.string()), pa.array([status], pa.int32()), pa.array([html], pa.string()), pa.array([attempts], pa.list_(ATTEMPT))]
                yield pa.RecordBatch.from_arrays(arrays, names=[key, url, "status", "html", "attempts"])

    rows = urls.select(F.col(key), F.col(url).cast("string"))
    rows = rows.repartition(tasks) if tasks else rows
    return rows.mapInArrow(run, f"`{key}` {kind}, `{url}` string, status int, html string, attempts array<struct<status: int, error: string, waited: double>>")
