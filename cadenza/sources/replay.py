"""A transport that answers from recorded pages in place of the network: reruns of a fetch without fetching.

`record` writes one file for each request; `fetch` is the transport, with the folder as the connectors' base. A request
that was not recorded is an error, so a replay can't silently return less.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.named import opened, write_named


def request_key(url: str, body: dict | None) -> str:
    """What tells requests apart: the path below the base, and of a query its repository and cursor."""
    at = max(url.find("/repos/"), url.find("/measures/"))
    if body is None:
        return url[at:]
    variables = body["variables"]
    return f"/graphql/{variables['owner']}/{variables['name']}/{variables.get('cursor') or ''}"


def record(pages: DataFrame, path: str) -> None:
    """Writes (request, body): the request as `request_key` gives it, the body as JSON text."""
    write_named(pages.select("body", "request"), path, _name(F.col("request")), "json", "text")


def _name(request: Column) -> Column:
    return F.sha2(request, 256)


def fetch(url: str, body: dict | None, token: str) -> dict | list:
    key = request_key(url, body)
    base = url[: url.index("/graphql")] if body is not None else url[: url.index(key)]
    store, folder = opened(base)
    with store.open_input_stream(f"{folder}/{hashlib.sha256(key.encode()).hexdigest()}.json") as file:
        return json.loads(file.readall())
