"""Steps outside the engine, behind protocols: fetching, text extraction, OCR and language models. The engine calls them on
executors, in batches; tests use fakes. Only the decisions around them are made here."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Fetcher(Protocol):
    def fetch(self, url: str) -> bytes | None: ...


class PageReader(Protocol):
    """Pages of a document: dicts of page_number, text, blocks and has_table."""

    def pages(self, content: bytes) -> list[dict[str, Any]]: ...


class OcrEngine(Protocol):
    name: str

    def is_available(self) -> bool: ...

    def extract(self, content: bytes, page: int, attempt: int) -> dict[str, Any]: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str, system: str) -> str: ...


_engines: dict[str, Callable[[], OcrEngine]] = {}


def register_engine(name: str, make: Callable[[], OcrEngine]) -> None:
    _engines[name] = make


def engine(name: str, fallback: str | None = None) -> OcrEngine:
    """The named engine, or the fallback where that isn't there or not available."""
    for choice in (name, fallback):
        if choice in _engines and (made := _engines[choice]()).is_available():
            return made
    raise LookupError(f"no OCR engine {name!r}")


def read_with_retry(ocr: OcrEngine, content: bytes, page: int, good: float = 55.0, most_low: float = 35.0) -> dict[str, Any]:
    """A first reading if it is good enough, else the better of two."""
    first = ocr.extract(content, page, 1)
    if first["avg_confidence"] >= good and first["low_conf_percentage"] <= most_low:
        return first
    second = ocr.extract(content, page, 2)
    return second if second["avg_confidence"] > first["avg_confidence"] else first


def fetch_all(urls: DataFrame, make: Callable[[], Fetcher], url: str = "url") -> DataFrame:
    """url and content; null where fetching failed. Certificates are never passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher = make()
        for b in batches:
            contents = []
            for u in b[url]:
                try:
                    contents.append(fetcher.fetch(u))
                except OSError:  # a source that can't be reached is a row without content
                    contents.append(None)
            yield pd.DataFrame({url: b[url], "content": contents})

    return urls.select(url).mapInPandas(run, f"{url} string, content binary")


def scan_pages(files: DataFrame, make: Callable[[], PageReader]) -> DataFrame:
    """Pages of binary files (path, content): path, page_number, text, blocks, has_table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows = [(path, p.get("page_number", i + 1), p.get("text", ""), len(p.get("blocks") or []), bool(p.get("has_table"))) for i, p in enumerate(reader.pages(content))]
                yield pd.DataFrame(rows, columns=["path", "page_number", "text", "blocks", "has_table"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, blocks int, has_table boolean")


def extract_rules(pages: DataFrame, make: Callable[[], LanguageModel], system: str, attempts: int = 3) -> DataFrame:
    """Answers of a model to pages (path, page_number, text) as JSON strings; null where all attempts failed. Filter pages first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "page_number": b["page_number"], "answer": [ask(model, t, system, attempts) for t in b["text"]]})

    return pages.select("path", "page_number", "text").mapInPandas(run, "path string, page_number int, answer string")


def ask(model: LanguageModel, prompt: str, system: str, attempts: int = 3) -> str | None:
    for _ in range(attempts):
        try:
            return json.dumps(repair_json(model.complete(prompt, system)), ensure_ascii=False)
        except (ValueError, OSError):
            continue
    return None


def repair_json(answer: str) -> Any:
    """JSON of a model's answer: as it is, without what stands around it, else mended; if that has no lists of rules, the rules
    that are found anywhere in it. ValueError where there is nothing in braces."""
    text = answer or ""
    first, last = text.find("{"), text.rfind("}")
    for form in (text, text[first : last + 1] if 0 <= first < last else ""):
        try:
            return json.loads(form)
        except ValueError:
            continue
    if first < 0:
        raise ValueError("no JSON in the answer")
    mended = closed_json(text[first:])
    try:
        found = json.loads(mended)
    except ValueError:
        found = _objects(mended)
    if isinstance(found, dict) and {"eligibility_rules", "exclusion_rules"} & found.keys():
        return found
    rules = list(_rules_in(found))
    if not rules and isinstance(found, dict):
        return found
    out: dict[str, list] = {"eligibility_rules": [], "exclusion_rules": []}
    for rule in rules:
        out["exclusion_rules" if rule["type"] == "exclusion" else "eligibility_rules"].append(rule)
    return out


def closed_json(text: str) -> str:
    """Text that begins with a brace, made well-formed as far as brackets and strings go: a quotation mark ends a string only
    before what may follow one, commas before a closing bracket go, and what is open at the end is closed. Text after the
    outermost brace is left out."""
    out: list[str] = []
    open_brackets: list[str] = []
    in_string, i = False, 0
    pairs = {"{": "}", "[": "]"}
    while i < len(text):
        c = text[i]
        if in_string:
            if c == "\\" and i + 1 < len(text):
                out.append(text[i : i + 2])
                i += 1
            elif c == '"':
                after = text[i + 1 :].lstrip()
                in_string = bool(after) and after[0] not in ",:]}"
                out.append('\\"' if in_string else '"')
            else:
                out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c))
        elif c == '"':
            in_string = True
            out.append(c)
        elif c in pairs:
            open_brackets.append(pairs[c])
            out.append(c)
        elif c in "]}":
            if c in open_brackets:  # brackets inside that were never closed end here, too
                while True:
                    closing = open_brackets.pop()
                    _drop_comma(out)
                    out.append(closing)
                    if closing == c:
                        break
            if not open_brackets:
                break
        else:
            out.append(c)
        i += 1
    if in_string:
        out.append('"')
    for closing in reversed(open_brackets):
        _drop_comma(out)
        out.append(closing)
    return "".join(out)


def _drop_comma(out: list[str]) -> None:
    while out and (out[-1].isspace() or out[-1] == ","):
        out.pop()


def _objects(text: str) -> list:
    """The objects that can be read from text, from left to right."""
    decoder, found, i = json.JSONDecoder(), [], text.find("{")
    while i >= 0:
        try:
            one, end = decoder.raw_decode(text, i)
            found.append(one)
        except ValueError:
            end = i + 1
        i = text.find("{", end)
    return found


def _rules_in(value: Any) -> Iterator[dict]:
    """Objects with a rule, at any depth; without a type they are of eligibility, or of exclusion below a key that says so."""

    def walk(v: Any, kind: str) -> Iterator[dict]:
        if isinstance(v, dict):
            if isinstance(v.get("rule"), str) and v["rule"]:
                yield {"type": kind, "evidence": ""} | {k: v[k] for k in ("rule", "type", "evidence") if isinstance(v.get(k), str)}
            else:
                for k, x in v.items():
                    yield from walk(x, "exclusion" if "exclu" in k.lower() else kind)
        elif isinstance(v, list):
            for x in v:
                yield from walk(x, kind)

    return walk(value, "eligibility")


def download_and_register(urls: DataFrame, make: Callable[[], Fetcher], known: DataFrame, url: str = "url") -> DataFrame:
    """(url, file_hash, file_size, status, document_url): new, unchanged or download_failed.

    ``known``: file_hash and document_url of registered documents. Content that is known, or that an earlier address of the same
    table has (in order of addresses), is unchanged and names the document that holds it. A null address fails."""
    fetched = fetch_all(urls.where(F.col(url).isNotNull()).distinct(), make, url)
    got = fetched.select(F.col(url).alias("url"), F.sha2("content", 256).alias("file_hash"), F.length("content").cast("long").alias("file_size"))
    held = known.groupBy(F.col("file_hash").alias("_hash")).agg(F.min("document_url").alias("_held"))
    firsts = got.where("file_hash IS NOT NULL").groupBy(F.col("file_hash").alias("_h")).agg(F.min("url").alias("_first"))
    out = got.join(held, F.col("file_hash") == F.col("_hash"), "left").join(firsts, F.col("file_hash") == F.col("_h"), "left")
    holder = F.coalesce("_held", "_first")
    status = F.when(F.col("file_hash").isNull(), "download_failed").when(F.col("_held").isNotNull() | (F.col("url") != F.col("_first")), "unchanged").otherwise("new")
    lost = urls.where(F.col(url).isNull()).select(F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("long").alias("file_size"), F.lit("download_failed").alias("status"), F.lit(None).cast("string").alias("document_url"))
    return out.select("url", "file_hash", "file_size", status.alias("status"), holder.alias("document_url")).unionByName(lost)


@dataclass
class Tools:
    """Named functions with their documentation. A failed call is a result, not an exception."""

    known: dict[str, tuple[Callable, str]] = field(default_factory=dict)

    def register(self, name: str, function: Callable, doc: str = "") -> None:
        self.known[name] = (function, doc or (function.__doc__ or ""))

    def call(self, name: str, **arguments: Any) -> dict[str, Any]:
        if name not in self.known:
            return {"success": False, "error": f"no tool {name!r}", "tools": sorted(self.known)}
        try:
            return {"success": True, "result": self.known[name][0](**arguments)}
        except Exception as error:  # the caller decides on the next step
            return {"success": False, "error": f"{type(error).__name__}: {error}"}
