"""Tickets: a tracker's JSON as a table, from files or from a client that asks in batches."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TicketError
from ..functions.text import strip_control
from ..operators.audit import BATCH

_STATE = "state struct<name:string,type:string>"
_REF = f"struct<identifier:string,title:string,{_STATE.replace(' ', ':', 1)}>"
TICKET = f"struct<identifier:string,number:decimal(38,0),title:string,url:string,{_STATE.replace(' ', ':', 1)},parent:{_REF},children:struct<nodes:array<{_REF}>>>"
RESPONSE = f"struct<errors:array<struct<message:string>>,data:struct<issues:struct<nodes:array<{TICKET}>>>>"
TIMEOUT_S, ATTEMPTS, MOST_BYTES, MOST_WAIT_S = 30, 3, 5 << 20, 30

_STATE_QL = "state { type name }"
_QUERY = f"""query Tickets($key: String!, $wanted: [Float!]!) {{
  issues(includeArchived: true, first: {BATCH}, filter: {{number: {{in: $wanted}}, team: {{key: {{eq: $key}}}}}}) {{
    nodes {{
      number identifier url title {_STATE_QL}
      parent {{ identifier title {_STATE_QL} }}
      children(first: {BATCH}) {{ nodes {{ identifier title {_STATE_QL} }} }}
    }}
  }}
}}
"""


def build_query(team: str, numbers: list[int]) -> dict:
    """The body of one request. Archived tickets are asked for too: what shipped is what gets archived."""
    return {"query": _QUERY, "variables": {"key": team, "wanted": numbers}}


def requests(batches: DataFrame) -> DataFrame:
    """(team, batch, body) of ``ticket_batches``: the JSON that each request carries, as ``build_query`` makes it."""
    wanted = F.transform(F.split("numbers", ","), lambda n: n.cast("decimal(38,0)"))
    body = F.struct(F.lit(_QUERY).alias("query"), F.struct(F.col("team").alias("key"), wanted.alias("wanted")).alias("variables"))
    return batches.select("team", "batch", F.to_json(body).alias("body"))


def parse_responses(responses: DataFrame) -> DataFrame:
    """(ticket_ref, ticket) of (team, response). A ticket goes by the number that was asked for, not by its current name.

    ``TicketError`` if a response isn't such JSON, reports errors, or has a ticket without number, name, address or state.
    """
    read = responses.select("team", "response", F.from_json("response", RESPONSE, {"mode": "PERMISSIVE"}).alias("r"))
    bad = read.where("r.data.issues.nodes is null or size(r.errors) > 0").select("response", F.transform("r.errors", lambda e: e["message"]).alias("m")).first()
    if bad:
        raise TicketError(f"the tracker reports: {'; '.join(x or '?' for x in bad['m'])}" if bad["m"] else "a response of the tracker is malformed")
    one = read.select("team", F.explode("r.data.issues.nodes").alias("t"))
    need = " or ".join(f"{c} is null" for c in ("t", "t.identifier", "t.number", "t.url", "t.state.name", "t.state.type"))
    if not one.where(need).isEmpty():
        raise TicketError("a ticket of the tracker is malformed")
    ref = lambda x: F.struct(strip_control(x["identifier"]).alias("identifier"), strip_control(x["title"]).alias("title"), _clean_state(x).alias("state"))
    t = F.col("t")
    ticket = F.struct(
        strip_control(t["identifier"]).alias("identifier"),
        strip_control(t["title"]).alias("title"),
        strip_control(t["url"]).alias("url"),
        _clean_state(t).alias("state"),
        F.when(t["parent"].isNotNull(), ref(t["parent"])).alias("parent"),
        F.coalesce(F.transform(t["children"]["nodes"], ref), F.array().cast(f"array<{_REF}>")).alias("children"),
    )
    return one.select(F.concat_ws("-", "team", F.col("t.number").cast("string")).alias("ticket_ref"), ticket.alias("ticket"))


def _clean_state(x):
    return F.struct(strip_control(x["state"]["name"]).alias("name"), strip_control(x["state"]["type"]).alias("type"))


def fetch(spark: SparkSession, batches: DataFrame, execute: Callable[[dict], str]) -> DataFrame:
    """(ticket_ref, ticket) of ``ticket_batches``. An audit has ten batches at most, so the driver asks; without any, it doesn't."""
    asked = [(b["team"], [int(n) for n in b["numbers"].split(",")]) for b in batches.orderBy("team", "batch").toLocalIterator()]
    return parse_responses(spark.createDataFrame([(team, execute(build_query(team, numbers))) for team, numbers in asked], "team string, response string"))


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *_):
        return None


class Client:
    """Posts queries over HTTPS: no redirects, a few attempts, bounded waits and sizes. The key is asked for when first needed."""

    def __init__(self, url: str, key: Callable[[], str | None], sleep: Callable[[float], None] = time.sleep, opener=None):
        if not url.startswith("https://"):
            raise TicketError("the tracker's address must be https")
        self.url, self.key, self.sleep = url, key, sleep
        self.open = (opener or urllib.request.build_opener(_NoRedirect())).open

    def execute(self, body: dict) -> str:
        key = self.key()
        if not key:
            raise TicketError("there is no key for the tracker")
        request = urllib.request.Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": key})
        why = ""
        for attempt in range(ATTEMPTS):
            wait = 2.0**attempt
            try:
                with self.open(request, timeout=TIMEOUT_S) as response:
                    data = response.read(MOST_BYTES + 1)
                if len(data) > MOST_BYTES:
                    raise TicketError(f"the tracker's response has more than {MOST_BYTES} bytes")
                return data.decode("utf-8")
            except urllib.error.HTTPError as error:
                why = f"status {error.code}"
                if error.code != 429 and error.code < 500:
                    break
                after = error.headers.get("Retry-After") if error.headers else None
                wait = min(float(after), MOST_WAIT_S) if after and after.isdigit() else wait
            except (urllib.error.URLError, TimeoutError, OSError) as error:
                why = str(error)
            except UnicodeDecodeError as error:
                raise TicketError("the tracker's response isn't UTF-8") from error
            if attempt + 1 < ATTEMPTS:
                self.sleep(wait)
        raise TicketError(f"the tracker can't be asked: {why}")
