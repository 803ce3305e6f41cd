"""HTML pages to records: one parse of a page gives all its facts."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import normalize_one
from .markup import Markup, objects

# Elements whose text isn't shown, and regions of a page.
HIDDEN = {"script", "style", "noscript", "template", "head", "title"}
REGIONS = ("header", "nav", "main", "aside", "footer")
# Hosts of embedded players, and keys of metadata and types of nodes that tell of a video.
PLAYERS = r"youtube|youtu\.be|vimeo|wistia"
VIDEO_META = ("og:video", "og:video:url", "og:video:secure_url", "twitter:player")
VIDEO_TYPES = {"videoobject", "clip", "broadcastevent", "seektoaction"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

SCHEMA = (
    "title string, meta_description string, meta_robots string, canonical_url string, canonical_count int, language string, "
    "h1 string, h1_count int, headings array<struct<level:int,text:string>>, word_count int, content_hash string, "
    "internal_links_out int, external_links_out int, links array<struct<href:string,text:string,region:string,nofollow:boolean,internal:boolean>>, "
    "hreflang array<struct<lang:string,href:string>>, rel_next string, rel_prev string, "
    "image_count int, images array<struct<src:string,alt:string,width:string,height:string,loading:string,srcset:boolean,heading:string>>, "
    "videos array<struct<src:string,poster:string,kind:string>>, schema_types array<string>, schema_parse_error_count int, schema_nodes array<struct<types:array<string>,fields:map<string,string>>>, shown_text string, "
    "og map<string,string>, script_count int, module_script_count int, data_nosnippet_count int, is_noindex int, is_nofollow int"
)


def squeeze(text: str) -> str:
    return " ".join(text.split())


class Page(HTMLParser):
    """Collects a page's facts while it is read; open elements need not be closed."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.text: list[str] = []
        self.titles: list[str] = []
        self.meta: dict[str, list[str]] = {}
        self.canonicals: list[str] = []
        self.hreflang: list[tuple[str, str]] = []
        self.next = self.prev = self.language = ""
        self.headings: list[tuple[int, str]] = []
        self.links: list[list] = []
        self.images: list[dict] = []
        self.videos: list[dict] = []
        self.types: set[str] = set()
        self.markup = Markup()
        self.errors = self.scripts = self.modules = self.nosnippet = 0
        self.parts: dict[str, list[str]] = {}
        self.json_ld = False

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        self.markup.opened(a, tag in VOID)
        if tag not in VOID:
            self.open.append(tag)
        self.nosnippet += "data-nosnippet" in a
        if "itemtype" in a:
            self.types.update(x.rsplit("/", 1)[-1] for x in a["itemtype"].split())
        if "typeof" in a:
            self.types.update(x.rsplit(":", 1)[-1] for x in a["typeof"].split())
        if tag == "html":
            self.language = a.get("lang", "")
        elif tag == "meta":
            name = (a.get("name") or a.get("property") or "").strip().lower()
            if name:
                self.meta.setdefault(name, []).append(a.get("content", ""))
        elif tag == "link" and squeeze(a.get("href", "")):
            self._link_element(squeeze(a["href"]), set(a.get("rel", "").lower().split()), squeeze(a.get("hreflang", "")))
        elif tag == "a" and a.get("href"):
            region = next((r for r in reversed(self.open) if r in REGIONS), "body")
            self.links.append([a["href"].strip(), "", region, "nofollow" in a.get("rel", "").lower().split()])
        elif tag == "img":
            self.images.append({"src": a.get("src") or a.get("data-src", ""), "alt": a.get("alt"), "width": a.get("width", ""), "height": a.get("height", ""), "loading": a.get("loading", ""), "srcset": "srcset" in a, "heading": self.headings[-1][1][:180] if self.headings else ""})
        elif tag == "video":
            self.videos.append({"src": a.get("src", ""), "poster": a.get("poster", ""), "kind": "video"})
        elif tag == "source" and "video" in self.open and self.videos and not self.videos[-1]["src"]:
            self.videos[-1]["src"] = a.get("src", "")
        elif tag == "iframe" and re.search(PLAYERS, _host(a.get("src", ""))):
            self.videos.append({"src": a["src"], "poster": "", "kind": "embed"})
        elif tag == "script":
            self.scripts += 1
            self.modules += a.get("type", "").lower() == "module"
            self.json_ld = a.get("type", "").strip().lower() == "application/ld+json"
        if tag in ("title", "h1", "h2", "h3", "h4", "h5", "h6", "a", "script"):
            self.parts[tag] = []

    def _link_element(self, href: str, rel: set[str], lang: str) -> None:
        if "canonical" in rel:
            self.canonicals.append(href)
        if "alternate" in rel and lang:
            self.hreflang.append((lang.lower(), href))
        if "next" in rel:
            self.next = self.next or href
        if rel & {"prev", "previous"}:
            self.prev = self.prev or href

    def handle_data(self, data: str) -> None:
        self.markup.said.append(data)
        for parts in self.parts.values():
            parts.append(data)
        if not HIDDEN.intersection(self.open):
            self.text.append(data)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.open:
            while self.open.pop() != tag:
                self.markup.closed()
            self.markup.closed()
        if tag not in self.parts:
            return
        raw = "".join(self.parts.pop(tag))
        text = squeeze(raw)
        if tag == "title" and text:
            self.titles.append(text)
        elif tag == "a" and self.links:
            self.links[-1][1] = text
        elif tag == "script" and self.json_ld:
            self.json_ld = False
            try:
                self.markup.add(raw)
                self._types_of(json.loads(raw or "null"))
            except (ValueError, RecursionError):
                self.errors += bool(raw.strip())
        elif tag[0] == "h" and text:
            self.headings.append((int(tag[1]), text))

    def _types_of(self, value: object) -> None:
        for node in objects(value):
            kinds = node.get("@type", [])
            self.types.update(str(k) for k in (kinds if isinstance(kinds, list) else [kinds]))


def _host(url: str) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "").lower()
    except ValueError:
        return ""


def internal(href: str, base: str) -> bool:
    host = (urlsplit(urljoin(base, href)).hostname or "").removeprefix("www.")
    return host == (urlsplit(base).hostname or "").removeprefix("www.")


def parse(html: str | None, url: str | None) -> dict:
    """All facts of a page; an empty page has empty facts."""
    p, base = Page(), url or ""
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):
        pass
    words = [w for w in re.split(r"\W+", squeeze(" ".join(p.text))) if w]
    shown = squeeze(" ".join(p.text)).casefold()
    links = []
    for href, text, region, nofollow in p.links:
        try:
            scheme = urlsplit(href).scheme.lower()
            if href.startswith("#") or scheme not in ("", "http", "https"):
                continue
            links.append({"href": normalize_one(href, base) or href, "text": text, "region": region, "nofollow": nofollow, "internal": internal(href, base)})
        except ValueError:
            continue
    robots = ",".join(p.meta.get("robots", [])).lower().replace(" ", "").split(",")
    first = lambda name: squeeze(p.meta.get(name, [""])[0])
    absolute = lambda href: normalize_one(href, base) or "" if href else ""
    h1 = [t for level, t in p.headings if level == 1]
    nodes = p.markup.finished()
    videos = p.videos + [{"src": n["fields"].get("contentUrl", ""), "poster": n["fields"].get("thumbnailUrl", ""), "kind": "schema"} for n in nodes if VIDEO_TYPES.intersection(t.lower() for t in n["types"])]
    videos += [{"src": v.strip(), "poster": "", "kind": "metadata"} for name in VIDEO_META for v in p.meta.get(name, []) if v.strip()]
    return {
        "title": p.titles[0] if p.titles else "", "meta_description": first("description"), "meta_robots": ", ".join(p.meta.get("robots", [])), "canonical_url": absolute(p.canonicals[0]) if p.canonicals else "",
        "canonical_count": len(p.canonicals), "language": p.language, "h1": h1[0] if h1 else "", "h1_count": len(h1), "headings": [{"level": a, "text": b} for a, b in p.headings], "word_count": len(words),
        "content_hash": hashlib.sha256(shown.encode()).hexdigest() if shown else "", "internal_links_out": sum(x["internal"] for x in links), "external_links_out": sum(not x["internal"] for x in links), "links": links,
        "hreflang": [{"lang": a, "href": b} for a, b in dict.fromkeys((a, absolute(b)) for a, b in p.hreflang)], "rel_next": absolute(p.next), "rel_prev": absolute(p.prev), "image_count": len(p.images), "images": p.images, "videos": videos,
        "schema_types": sorted(p.types), "schema_parse_error_count": p.errors, "schema_nodes": nodes, "shown_text": squeeze(" ".join(p.text)), "og": {k: squeeze(v[0]) for k, v in p.meta.items() if k.startswith(("og:", "twitter:"))}, "script_count": p.scripts, "module_script_count": p.modules,
        "data_nosnippet_count": p.nosnippet, "is_noindex": int(bool({"noindex", "none"}.intersection(robots))), "is_nofollow": int(bool({"nofollow", "none"}.intersection(robots))),
    }


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores where fewer partitions than cores hold them (few, well compressed files); more are not shuffled."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def extract(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, url and the facts of every page."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            facts = [parse(h, u) for h, u in zip(frame["html"], frame["url"], strict=True)]
            yield pd.concat([frame[["k", "url"]].reset_index(drop=True), pd.DataFrame(facts, columns=[f.split()[0] for f in _names()])], axis=1)

    kind = pages.schema[key].dataType.simpleString()
    rows = spread(pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.col(html).alias("html")))
    return rows.mapInPandas(run, f"k {kind}, url string, {SCHEMA}").withColumnRenamed("k", key)


def _names() -> list[str]:
    """Names of SCHEMA's columns."""
    depth, names, at = 0, [], ""
    for c in SCHEMA + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            names.append(at.strip())
            at = ""
        else:
            at += c
    return names


# Marks of file names that say nothing, formats, and the width of a large image.
PLAIN_FILES, FORMATS, LARGE = "img|image|photo|dsc|screenshot", ["jpg", "jpeg", "png", "webp", "gif", "avif", "svg"], 1200


def image_facts(images: Column) -> Column:
    """Images with the quality of their text and file name, their format, and how often the page uses them. Images without a source are left out."""
    path = lambda i: F.regexp_replace(i["src"], r"[?#].*$", "")
    name = lambda i: F.lower(F.regexp_extract(path(i), r"([^/]*)/*$", 1))
    alt = lambda i: F.lower(F.trim(F.coalesce(i["alt"], F.lit(""))))
    shown = F.filter(images, lambda i: F.trim(F.coalesce(i["src"], F.lit(""))) != "")
    fmt = lambda i: F.regexp_extract(name(i), r"[^.]\.([a-z0-9_-]+)$", 1)
    return F.transform(
        shown,
        lambda i: F.struct(
            i["src"].alias("src"),
            F.when(alt(i) == "", "missing").when(F.length(alt(i)) < 4, "weak").when(alt(i).rlike(r"^(image|photo|picture|img|logo|hero)\s*\d*$"), "generic").otherwise("descriptive").alias("alt_quality"),
            F.when(name(i) == "", "missing").when(name(i).rlike(PLAIN_FILES), "generic").when(name(i).rlike("[-_]"), "descriptive").otherwise("basic").alias("filename_quality"),
            fmt(i).alias("format"),
            fmt(i).isin(FORMATS).alias("format_supported"),
            (i["heading"] != "").alias("near_heading"),
            F.coalesce(i["width"].try_cast("int"), F.lit(0)).alias("width"),
            F.size(F.filter(shown, lambda o: o["src"] == i["src"])).alias("uses"),
        ),
    )


def image_scores(facts: DataFrame, key: str) -> DataFrame:
    """key, images, their ratios and discoverability (0..100). Without images the ratios of texts, names and formats are 1, the others 0."""
    rows = facts.select(key, image_facts(F.col("images")).alias("i"))
    n = F.size("i")
    share = lambda condition, empty: F.when(n == 0, F.lit(empty)).otherwise(F.size(F.filter("i", condition)) / n)
    ratios = {
        "alt_coverage": share(lambda i: i["alt_quality"] != "missing", 1.0),
        "descriptive_alt_ratio": share(lambda i: i["alt_quality"] == "descriptive", 1.0),
        "descriptive_filename_ratio": share(lambda i: i["filename_quality"] == "descriptive", 1.0),
        "supported_format_ratio": share(lambda i: i["format_supported"], 1.0),
        "contextual_ratio": share(lambda i: i["near_heading"], 0.0),
        "large_image_ratio": share(lambda i: i["width"] >= LARGE, 0.0),
        "asset_reuse_ratio": share(lambda i: i["uses"] > 1, 0.0),
    }
    points = sum((r * w for r, w in zip(ratios.values(), (25.0, 10.0, 20.0, 15.0, 10.0, 10.0, 10.0), strict=True)), F.lit(0.0))
    return rows.select(key, n.alias("images"), *[r.alias(k) for k, r in ratios.items()], F.bround(points, 0).cast("int").alias("discoverability"))


def video_scores(facts: DataFrame, key: str, sitemap_videos: Column | None = None) -> DataFrame:
    """key, videos, which kinds of evidence a page has, and discoverability (0..100). sitemap_videos: their number at the page's sitemap entry."""
    listed = F.coalesce(sitemap_videos, F.lit(0)) if sitemap_videos is not None else F.lit(0)
    has = lambda kind: F.exists("videos", lambda v: v["kind"] == kind)
    # Points of each kind of evidence.
    points = {"schema": (has("schema"), 40), "embed": (has("embed"), 25), "tag": (has("video"), 25), "metadata": (has("metadata"), 5), "sitemap": (listed > 0, 5)}
    n = F.size("videos") + listed
    score = sum((F.when(c, v).otherwise(0) for c, v in points.values()), F.when(n > 0, 10).otherwise(0))
    return facts.select(key, n.cast("int").alias("videos"), *[c.cast("int").alias(f"has_{k}") for k, (c, _) in points.items()], F.least(F.lit(100), score).cast("int").alias("discoverability"))


def edges(facts: DataFrame, source: str = "url") -> DataFrame:
    """source_url, normalized_target_url, anchor, region, is_internal of every link."""
    return facts.select(F.col(source).alias("source_url"), F.explode("links").alias("l")).select("source_url", F.col("l.href").alias("normalized_target_url"), F.col("l.text").alias("anchor"), F.col("l.region").alias("region"), F.col("l.internal").cast("int").alias("is_internal"))
