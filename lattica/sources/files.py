"""Source trees, JSON extractions, pages and search results as DataFrames."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.functions import paths as P

EXTRACTION = (
    "metadata struct<export_timestamp:string,total_files:long,extractor_version:string>, "
    "files map<string,struct<id:long,language:string,content:string,content_hash:string,blocks:string,relationships:array<struct<source_id:long,target_id:long,import_content:string,symbols:array<string>,type:string>>>>"
)


def scan(spark: SparkSession, path: str, hashes_only: bool = False) -> DataFrame:
    """(file_path, id, language, content, content_hash, size) of the text files below a directory.

    One scan serves index and change detection. Ignored files and directories are left out before
    contents are looked at; binary files by their first bytes. Spark's file source lists no empty files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    at = F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", "")
    base = F.lit(path.split("://", 1)[-1].rstrip("/"))
    rows = raw.select(at.alias("file_path"), "content", "length").filter(~P.ignored_below(F.col("file_path"), base) & P.is_text("content"))
    keyed = rows.select("file_path", P.file_id("file_path").alias("id"), P.language("file_path").alias("language"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size"), "content")
    return keyed.drop("content") if hashes_only else keyed.withColumn("content", P.decode("content"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, size, modified) without reading contents."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.regexp_replace("path", "^[a-z]+:(//[^/]*)?", "").alias("file_path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_extraction(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, id, language, content, content_hash, blocks, relationships) of JSON extractions.

    ``blocks`` stays JSON: blocks hold their children to any depth, which no schema can say; ``store.flatten_blocks`` reads it.
    """
    return spark.read.schema(EXTRACTION).option("multiLine", True).json(path).select(F.explode("files").alias("file_path", "f")).select("file_path", "f.*")


def latest_extraction(spark: SparkSession, folder: str, project: str) -> str | None:
    """Path of a project's newest extraction; both naming forms count."""
    files = listing(spark, folder).withColumn("name", P.basename("file_path")).filter(F.col("name").rlike(f"^{project}_(extraction_)?[0-9_\\-]+\\.json$"))
    return files.agg(F.max_by("file_path", F.regexp_extract("name", r"([0-9_\-]+)\.json$", 1))).first()[0]


class _Text(HTMLParser):
    """Visible text, and if asked for, in the same pass, Markdown with headings, links, lists and emphasis."""

    SKIP, BREAK = {"script", "style", "noscript", "template", "nav", "footer", "head"}, {"p", "div", "br", "li", "tr", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "pre", "blockquote"}

    def __init__(self, markdown: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.marked, self.skip, self.markdown, self.links = [], [], 0, markdown, []

    def put(self, text: str) -> None:
        self.out.append(text)
        if self.markdown:
            self.marked.append(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.SKIP:
            self.skip += 1
        if tag in self.BREAK:
            self.put("\n")
        if self.markdown:
            if tag[0] == "h" and tag[1:].isdigit():
                self.marked.append("#" * int(tag[1:]) + " ")
            elif tag == "li":
                self.marked.append("- ")
            elif tag in ("b", "strong"):
                self.marked.append("**")
            elif tag == "a":
                self.links.append(dict(attrs).get("href") or "")
                self.marked.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        if self.markdown and tag in ("b", "strong"):
            self.marked.append("**")
        if self.markdown and tag == "a" and self.links:
            self.marked.append(f"]({self.links.pop()})")
        if tag in self.BREAK:
            self.put("\n")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.put(data)


def html_forms(html: str | None, markdown: bool = True) -> tuple[str | None, str | None]:
    """Text and Markdown of a page in one pass; without ``markdown`` the second is None."""
    if html is None:
        return None, None
    parser = _Text(markdown)
    parser.feed(html)
    parser.close()
    tidy = lambda parts: "\n".join(y for x in "".join(parts).split("\n") if (y := " ".join(x.split())))
    return tidy(parser.out), tidy(parser.marked) if markdown else None


def html_text(html: str | None, markdown: bool = False) -> str | None:
    return html_forms(html, markdown)[markdown]


@F.arrow_udf(T.StringType())
def page_text(html: pa.Array) -> pa.Array:
    return pa.array((html_text(x.as_py()) for x in html), pa.string())


@F.arrow_udf(T.StringType())
def page_markdown(html: pa.Array) -> pa.Array:
    return pa.array((html_text(x.as_py(), True) for x in html), pa.string())


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("markdown", T.StringType()))
def page_forms(html: pa.Array) -> pa.Array:
    """Text and Markdown of pages, each parsed once, one page at a time."""
    forms = ([], [])
    for x in html:
        for out, form in zip(forms, html_forms(x.as_py()), strict=True):
            out.append(form)
    return pa.StructArray.from_arrays([pa.array(out, pa.string()) for out in forms], ["text", "markdown"])


RESPONSE = (
    "web struct<results:array<struct<title:string,url:string,description:string,age:string>>>, "
    "results array<struct<title:string,url:string,description:string,age:string,source:string,properties:struct<url:string>>>"
)


def search_results(raw: DataFrame, json_col: str = "json", kind: Column | str = "web") -> DataFrame:
    """(kind, rank, title, url, description, age) from web, news, image and video responses alike."""
    j = F.from_json(F.col(json_col), RESPONSE)
    k = F.lit(kind) if isinstance(kind, str) else kind
    one = F.transform(j["web"]["results"], lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"), x["description"].alias("description"), x["age"].alias("age")))
    other = F.transform(j["results"], lambda x: F.struct(x["title"].alias("title"), F.coalesce(x["url"], x["properties"]["url"]).alias("url"), F.coalesce(x["description"], x["source"]).alias("description"), x["age"].alias("age")))
    return raw.select(k.alias("kind"), F.posexplode(F.coalesce(one, other)).alias("rank", "r")).select("kind", "rank", "r.*")


#: Fixed values of the search service: results a page, and the periods a search can be limited to.
PAGE = (1, 20)
PERIODS = {"day": "pd", "week": "pw", "month": "pm", "year": "py"}


def search_params(query: str, count: int = 10, offset: int = 0, period: str | None = None, safe: str = "moderate", **options: object) -> dict[str, str] | None:
    """Parameters of a search request, None for a blank query. Options that are None are left out, lists are joined by commas."""
    if not query.strip():
        return None
    shown = {bool: lambda v: str(int(v)), list: ",".join}
    chosen = {"country": "US", "units": "metric", "spellcheck": True, "extra_snippets": False, "tf": PERIODS[period] if period else None, **options}
    fixed = {"q": query.strip(), "count": str(_page_size(count)), "offset": str(max(0, offset)), "safesearch": safe}
    return fixed | {k: shown.get(type(v), str)(v) for k, v in chosen.items() if v is not None}


def _page_size(count: int) -> int:
    return min(max(count, PAGE[0]), PAGE[1])


def results_page(results: DataFrame, count: int = 10, offset: int = 0) -> DataFrame:
    """Page ``offset`` (from 0) of stored results with their ranks, as the service would cut them."""
    size = _page_size(count)
    start = max(0, offset) * size
    return results.filter((F.col("rank") >= start) & (F.col("rank") < start + size))
