"""Main text of web pages by equivalence classes of template tokens.

Every page is read into tokens: the roles of its elements (paths of tags, classes and
ids) and the texts that they hold.  Over the pages of a host a token has an occurrence
vector, its count on each page.  Vectors are never held: the bitwise sum of hashes of
(page, count) stands for one, so that tokens of one vector meet in a plain
aggregation, and a host of a third of all pages is combined before it is shuffled.
Tokens of one vector inside one element, on enough pages, are an equivalence class; it
is valid if they stand in one order on all pages.  The classes nest as their elements
do and make the host's template: elements that each page has once, and roles whose text
has the vector of the role itself, that is, says the same wherever the role occurs.
What remains are slots.  The article is in the slots of the main part: the `article`
or `main` element, else the innermost element of the template that holds most of
what varies, without parts that are named as menus, headers, footers, sidebars,
notices, adverts, forms or comments.

A host with fewer than MIN_PAGES different contents has no template: each of its pages
is its own.  A constant text must stand on half of the host's different contents, so
that copies of an article are no template.  Contents are told apart by the longest text.

Defined results: a null, empty or text-less html gives an empty text; a page without
tags is its own text; a null url is the host "".  White space is what Unicode calls so,
the no-break space included.  Repeated rows stay and get the same text.  Very long
pages are read whole, in one pass.  Extra columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.markup import main_text, read_page, texts_of
from lodeframe.llm.session import discard, ready, stored
from lodeframe.llm.urls import host_of
from lodeframe.sources.spread import spread

MIN_PAGES = 5
#: Least share of a host's pages that a class of the template occurs on.
MIN_SHARE = 0.5
#: Largest table of template roles that is broadcast; beyond it the joins shuffle.
BROADCAST_ROLES = 200_000

_TOKENS = "page long, site long, body long, role long, parent long, n int, first int, said long, chars long"


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page, site, html) to one row per page and role.

    body: hash of the page's longest text.  said: hash of the text that the role says, 0 where
    it says none and -1 where it says several.
    """
    for batch in batches:
        rows: list[tuple] = []
        for page_no, site, html in zip(*(c.to_pylist() for c in batch.columns)):
            page = read_page(html)
            texts = texts_of(page)
            body = xxhash.xxh3_64_intdigest(max(texts.values(), key=len, default="")) >> 1
            found: dict[int, list] = {}
            for e in range(1, len(page.tag)):
                role = page.role[e]
                if role == page.role[page.parent[e]]:
                    continue  # a part of the text around it
                own = texts.get(e, "")
                said, chars = xxhash.xxh3_64_intdigest(own) >> 1 if own else 0, len(own)
                known = found.get(role)
                if known is None:
                    found[role] = [page.role[page.parent[e]], 1, e, said, chars]
                else:
                    known[1] += 1
                    known[3] = known[3] if known[3] == said else -1
                    known[4] += chars
            rows += [(page_no, site, body, role, *x) for role, x in found.items()]
        names = [c.split() for c in _TOKENS.split(", ")]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "long" else pa.int32()) for c, (_, t) in zip(columns, names)], [n for n, _ in names])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, constant, skeleton, roles, mass) to (page_id, url, text)."""
    for batch in batches:
        html, constant, skeleton, roles, mass = (batch.column(k).to_pylist() for k in range(2, 7))
        said = [main_text(read_page(h), set(c or ()), set(s or ()), dict(zip(r or (), m or ()))) for h, c, s, r, m in zip(html, constant, skeleton, roles, mass)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(said, pa.string())], ["page_id", "url", "text"])


def _bounded(frame: DataFrame) -> DataFrame:
    """frame, to be broadcast if it is small."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROLES else frame


def deduce(pages: DataFrame) -> DataFrame:
    """Templates of pages (site, html): site, constant, skeleton, roles, mass, for sites with enough pages.

    constant: roles with the same text everywhere; skeleton: roles that are once on each page of
    their class; roles and mass: what a role says per page on average, in characters.
    """
    numbered = spread(pages.select("site", "html")).select(F.monotonically_increasing_id().alias("page"), "site", "html")
    tokens = stored(numbered.mapInArrow(_tokens, _TOKENS))
    bodies = tokens.select("site", "body").distinct().groupBy("site").agg(F.count("*").alias("bodies")).filter(F.col("bodies") >= MIN_PAGES)
    sites = tokens.groupBy("site", "page").agg(F.lit(1)).groupBy("site").agg(F.count("*").alias("pages")).join(bodies, "site")
    counted = tokens.groupBy("site", "role").agg(
        F.first("parent").alias("parent"),  # a role has one
        F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
        F.count("*").alias("on"),
        F.max("n").alias("most"),
        (F.min("said") == F.max("said")).alias("alike"),
        F.min("said").alias("said"),
        F.avg("chars").alias("mass"),
    )
    wide = stored(counted.join(sites, "site").filter(F.col("on") >= MIN_SHARE * F.col("pages")))
    # valid classes: the tokens of one vector inside one element in one order, where each of them is found first
    placed = tokens.select("site", "page", "role", "first").join(_bounded(wide.select("site", "role", "parent", "vector")), ["site", "role"])
    order = F.xxhash64(F.transform(F.array_sort(F.collect_list(F.struct("first", "role"))), lambda x: x["role"]))
    orders = placed.groupBy("site", "page", "parent", "vector").agg(order.alias("order"))
    valid = orders.groupBy("site", "parent", "vector").agg((F.min("order") == F.max("order")).alias("valid")).filter("valid").select("site", "parent", "vector")
    classes = wide.join(_bounded(valid), ["site", "parent", "vector"])
    # a constant text stands on half of the different contents, and copies of a content count once
    alike = classes.filter("alike AND said > 0").select("site", "role", "bodies")
    held = tokens.select("site", "role", "body").join(_bounded(alike), ["site", "role"]).distinct()
    constant = held.groupBy("site", "role", "bodies").agg(F.count("*").alias("held")).filter((F.col("held") >= MIN_PAGES) & (F.col("held") >= MIN_SHARE * F.col("bodies"))).select("site", "role", F.lit(True).alias("constant"))
    told = classes.join(constant, ["site", "role"], "left")
    # bounded: a role is on half of the pages of its site at least, so a site has at most twice the roles of a page
    listed = lambda value, when: F.collect_list(F.when(when, F.col(value)))
    out = told.groupBy("site").agg(listed("role", F.col("constant")).alias("constant"), listed("role", F.col("most") == 1).alias("skeleton"), F.collect_list("role").alias("roles"), F.collect_list("mass").alias("mass"))
    out = stored(out)
    discard(tokens, wide)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    ready(pages.sparkSession)
    site = F.xxhash64(host_of(F.col("url").cast("string"))).alias("site")
    known = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), site)
    whole = spread(known).join(_bounded(deduce(known)), "site", "left").select("page_id", "url", "html", "constant", "skeleton", "roles", "mass")
    types = dict(whole.dtypes)
    texts = whole.mapInArrow(_texts, f"page_id {types['page_id']}, url {types['url']}, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))
