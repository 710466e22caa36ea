"""Distributed HTML evidence extraction: a small parser per page, run over Arrow batches by Spark.

Batches are bounded in bytes on the way in and out.  Any markup gives a row: a
page whose address or markup can't be read has null evidence for what is
missing and says why in ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import small_batches
from .urls import has_user_info, host, is_http, normalize_url

_ASSET = "STRUCT<type STRING,url STRING,alt STRING,external BOOLEAN,mixed BOOLEAN,width STRING,height STRING,is_async BOOLEAN,is_defer BOOLEAN,loading STRING,media STRING,title STRING>"
EVIDENCE = (
    "title STRING, meta_description STRING, h1 STRING, headings ARRAY<STRUCT<level INT,text STRING>>, canonical STRING, robots_meta STRING, language STRING, json_ld ARRAY<STRING>, "
    "text STRING, word_count INT, image_count INT, missing_alt INT, links ARRAY<STRUCT<href STRING,anchor STRING,rel STRING>>, hreflang ARRAY<STRUCT<language STRING,target STRING>>, "
    f"open_graph MAP<STRING,STRING>, twitter MAP<STRING,STRING>, assets ARRAY<{_ASSET}>, error STRING"
)
#: Bytes of evidence handed on together.
TOGETHER = 4 << 20
_WORD = re.compile(r"[^\W_]+")
#: Elements that may stand before the body; anything else opens it.
_HEAD = {"html", "head", "title", "meta", "link", "script", "style", "base", "noscript", "template"}
_HEADING = re.compile("h[1-6]")
#: Declarations other than comments and document types are comments that end at the next bracket.
_BOGUS = re.compile(r"<!(?!--|doctype)[^>]*>?", re.IGNORECASE)
#: Elements of a body whose tags say nothing to the rules, plain or with simple attributes; a run of them with the text between is read at once.
_INERT = (
    r"</?(?:p|b|i|u|s|q|em|strong|small|big|span|div|br|hr|li|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|section|article|main|header|footer|nav|code|pre|blockquote|sub|sup|mark|abbr|cite|kbd|samp|var|tt|font"
    r"|center|address|figure|figcaption|label|time)(?:[ \t\r\n]++[a-z-]++=\"[^\"<>]*+\")*+[ ]?/?>"
)
_INERT_TAG = re.compile(_INERT, re.IGNORECASE)
_INERT_RUN = re.compile(f"(?:{_INERT}[^<&]*+)++", re.IGNORECASE)
_LARGEST_ANCHOR = 500
#: Evidence that is made of the text of whole pages.
_OF_TEXT = {"text", "word_count", "h1", "headings"}


def _clean(text: str | None) -> str | None:
    return " ".join((text or "").split()) or None


def _host(url: str) -> str | None:
    try:
        return urlsplit(url).hostname
    except ValueError:
        return None


class _Page(HTMLParser):
    """Collects what the rules need while the tags go by; an element's text is what the pieces from its start on hold."""

    def __init__(self, url: str, texts: bool = True):
        super().__init__(convert_charrefs=True)
        self.url, self.https, self.own = url, url.lower().startswith("https:"), _host(url)
        self.row = {
            "title": None, "meta_description": None, "h1": None, "headings": [], "canonical": None, "robots_meta": None, "language": None, "json_ld": [],
            "image_count": 0, "missing_alt": 0, "links": [], "hreflang": [], "open_graph": {}, "twitter": {}, "assets": [],
        }
        self.texts = texts  # else only text in elements whose text is wanted is kept
        self.pieces: list[str] = []
        self.open: list[tuple[str, int, dict]] = []  # elements whose text is wanted, and where it starts
        self.body: int | None = None
        self.templates = 0
        self.seen: set[str] = set()

    def run_from(self, i: int) -> int | None:
        """Where a run of inert tags from ``i`` on ends, with its text taken; before the body and in templates tags are read one by one."""
        run = _INERT_RUN.match(self.rawdata, i) if self.body is not None and not self.templates and self.cdata_elem is None else None
        if not run:
            return None
        if self.texts or self.open:
            self.pieces.append(_INERT_TAG.sub("", run[0]))
        self.lasttag = ""
        return run.end()

    def parse_starttag(self, i: int) -> int:
        end = self.run_from(i)
        return super().parse_starttag(i) if end is None else end

    def parse_endtag(self, i: int) -> int:
        end = self.run_from(i)
        return super().parse_endtag(i) if end is None else end

    def absolute(self, href: str | None) -> str | None:
        try:
            return None if href is None else urljoin(self.url, href.strip())
        except ValueError:
            return None

    def first(self, what: str) -> bool:
        """Whether this is the first element of a kind; the others count for nothing."""
        new = what not in self.seen
        self.seen.add(what)
        return new

    def asset(self, kind: str, href: str | None, a: dict, alt: str | None = None) -> None:
        url = self.absolute(href) if (href or "").strip() else None
        if url and url.lower().startswith(("http:", "https:")):
            script = kind == "Script"
            self.row["assets"].append(
                {
                    "type": kind, "url": url, "alt": alt, "external": _host(url) != self.own, "mixed": self.https and url.lower().startswith("http:"),
                    "width": a.get("width"), "height": a.get("height"), "is_async": script and "async" in a, "is_defer": script and "defer" in a,
                    "loading": a.get("loading"), "media": a.get("media"), "title": a.get("title"),
                }
            )

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k.lower(): v or "" for k, v in reversed(attrs)}
        if tag == "template":
            self.templates += 1
        if self.templates:
            return
        if tag == "body" or (self.body is None and tag not in _HEAD):
            self.body = len(self.pieces) if self.body is None else self.body
        getattr(self, f"on_{tag}", lambda a: None)(a)
        heading = _HEADING.fullmatch(tag)
        if tag in ("title", "a") or heading or (tag == "script" and a.get("type", "").lower() == "application/ld+json"):
            # A link ends the link before it, a heading the heading before it.
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == tag == "a" or (heading and _HEADING.fullmatch(self.open[i][0])):
                    self.close_at(i)
                    break
            self.open.append((tag, len(self.pieces), a))

    def on_html(self, a: dict) -> None:
        if self.first("html"):
            self.row["language"] = a.get("lang")

    def on_meta(self, a: dict) -> None:
        name, key, content = a.get("name", ""), a.get("property", ""), a.get("content")
        if name.lower() == "description" and self.first("description"):
            self.row["meta_description"] = _clean(content)
        elif name.lower() == "robots" and self.first("robots"):
            self.row["robots_meta"] = _clean(content)
        if content is not None:
            if key.lower().startswith("og:") and self.first(key.lower()):
                self.row["open_graph"][key] = content
            if name.lower().startswith("twitter:") and self.first(name.lower()):
                self.row["twitter"][name] = content

    def on_link(self, a: dict) -> None:
        rel, target = a.get("rel", "").lower().split(), self.absolute(a.get("href"))
        if "canonical" in rel and self.first("canonical"):
            self.row["canonical"] = target or a.get("href")
        if "alternate" in rel and "hreflang" in a and target and target.lower().startswith(("http:", "https:")):
            pair = {"language": a["hreflang"].strip(), "target": target}
            if pair not in self.row["hreflang"]:
                self.row["hreflang"].append(pair)
        if "stylesheet" in rel:
            self.asset("Stylesheet", a.get("href"), a)
        if "preload" in rel and a.get("as", "").lower() == "font":
            self.asset("Font", a.get("href"), a)

    def on_img(self, a: dict) -> None:
        self.row["image_count"] += 1
        self.row["missing_alt"] += not a.get("alt", "").strip()
        self.asset("Image", a.get("src"), a, _clean(a.get("alt")))

    def on_iframe(self, a: dict) -> None:
        self.asset("Iframe", a.get("src"), a, a.get("title"))

    def on_script(self, a: dict) -> None:
        self.asset("Script", a.get("src"), a)

    def handle_endtag(self, tag: str) -> None:
        if tag == "template":
            self.templates = max(0, self.templates - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                self.close_at(i)
                break

    def close_at(self, i: int) -> None:
        tag, start, a = self.open.pop(i)
        text, row = "".join(self.pieces[start:]), self.row
        if tag == "title":
            if self.first("title"):
                row["title"] = _clean(text)
        elif tag == "script":
            if text.strip():
                row["json_ld"].append(text.strip())
        elif tag == "a":
            if "href" in a:
                row["links"].append({"href": self.absolute(a["href"]), "anchor": (_clean(text) or "")[:_LARGEST_ANCHOR], "rel": a.get("rel")})
        elif _clean(text):
            row["headings"].append((start, {"level": int(tag[1]), "text": _clean(text)}))

    def handle_data(self, data: str) -> None:
        if self.templates:
            return
        if self.body is None and data.strip() and not self.open and self.cdata_elem is None and self.lasttag not in ("title", "noscript"):
            self.body = len(self.pieces)
        if self.texts or self.open:
            self.pieces.append(data)

    def result(self) -> dict:
        while self.open:  # elements that were never closed
            self.close_at(len(self.open) - 1)
        row = self.row
        if not self.texts:
            return row
        row["headings"] = [h for _, h in sorted(row["headings"], key=lambda x: x[0])]
        row["h1"] = next((h["text"] for h in row["headings"] if h["level"] == 1), None)
        text = _clean("".join(self.pieces[self.body :])) if self.body is not None else None
        return row | {"text": text or "", "word_count": len(_WORD.findall(text or ""))}


def page_row(url: str | None, html: str | None, texts: bool = True) -> dict:
    """Evidence of one page, without that made of its text if not ``texts``; an empty page for null html, nulls and the reason if it can't be read."""
    try:
        page = _Page(url or "", texts)
        page.feed(_BOGUS.sub("", html or ""))
        page.close()
        row = page.result() | {"error": None}
    except (AssertionError, ValueError, RecursionError) as e:
        return {"error": f"{type(e).__name__}: {e}"}
    try:
        urlsplit(url or "")
    except ValueError as e:
        row["error"] = f"url: {e}"
    return row


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", wanted: tuple[str, ...] | None = None) -> DataFrame:
    """Evidence columns of every raw page, keyed by ``id_col`` and url; all of them, or those ``wanted`` and the error.

    Texts are the text content of elements, as a parser of documents gives it:
    nothing is put between the parts, scripts and styles of the body count, and
    templates don't.
    """
    spark = pages.sparkSession
    small_batches(spark)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url STRING, {EVIDENCE}"
    empty = spark.createDataFrame([], schema)
    empty = empty if wanted is None else empty.select("page_id", "url", *wanted, "error")
    arrow = empty.toArrow().schema
    names, texts = arrow.names[2:], wanted is None or not _OF_TEXT.isdisjoint(wanted)

    def batch_of(ids: list, urls: list, found: list[dict]) -> pa.RecordBatch:
        columns = [ids, urls, *[[r.get(n) for r in found] for n in names]]
        maps = {"open_graph", "twitter"}
        return pa.RecordBatch.from_arrays([pa.array([None if v is None else list(v.items()) for v in c] if f.name in maps else c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, found, size = [], [], [], 0
            for i, url, html in zip(*[batch.column(c) for c in range(3)], strict=True):  # one page at a time leaves Arrow
                ids.append(i.as_py())
                urls.append(url.as_py())
                found.append(page_row(urls[-1], html.as_py(), texts))
                size += len(found[-1].get("text") or "") + 1_000
                if size > TOGETHER:
                    yield batch_of(ids, urls, found)
                    ids, urls, found, size = [], [], [], 0
            if found:
                yield batch_of(ids, urls, found)

    return rows.mapInArrow(run, empty.schema)


def page_links(evidence: DataFrame) -> DataFrame:
    """Links of each page: absolute http(s) targets with anchor, rel, whether internal and nofollow, normalised."""
    rows = evidence.select("page_id", "url", F.explode("links").alias("l")).select(F.col("page_id").alias("source_id"), "url", F.col("l.href").alias("target_url"), "l.anchor", "l.rel")
    rows = rows.filter(is_http(F.col("target_url")) & ~has_user_info(F.col("target_url"))).withColumn("normalized_target", normalize_url(F.col("target_url"))).filter("normalized_target is not null")
    tokens = F.split(F.lower(F.coalesce("rel", F.lit(""))), r"\s+")
    return rows.select("source_id", "target_url", "normalized_target", "anchor", "rel", (host(F.col("target_url")) == host(F.col("url"))).alias("is_internal"), F.array_contains(tokens, "nofollow").alias("is_nofollow"))


#: What ``page_meta`` takes of the evidence.
META = ("json_ld", "hreflang", "open_graph", "twitter")


def page_assets(evidence: DataFrame) -> DataFrame:
    return evidence.select("page_id", F.explode("assets").alias("a")).select("page_id", "a.*")


def page_meta(evidence: DataFrame) -> DataFrame:
    """Structured data, alternates and social maps of each page."""
    return evidence.select("page_id", *META)


