"""Contracts of JSON documents as tables of shapes, and what single values of a document break.

Texts are held as VARIANT and taken apart into rows of (doc_id, path, shape, value), level by level and without a shuffle. A
document is never more than its own rows, as its bytes are limited before it is parsed.

A shape is the name of a record, or one of list/least/most/shape of the elements, map/shape (an object with numbers as
keys), text/least/most (UTF-16 units), text?/least/most (or null), digits/least/most, choice/a|b, number/least/most, number,
whole (a positive whole number), flag, instant, url, and reading (a number or null). A field that ends in ? may be absent.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"(?i)^https?://[^/?#@\s]+([/?#]\S*)?\z"
FINDING = "struct<code:string,path:string,detail:string>"
_NUMBERS = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


def literal_map(of: dict) -> Column:
    pairs = [(F.lit(k), F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, list) else F.lit(v)) for k, v in of.items()]
    return F.create_map(*[x for pair in pairs for x in pair])


def instant(said: Column) -> Column:
    """Milliseconds of an ISO timestamp with an offset, or null."""
    iso = F.rlike(said, F.lit(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:\d\d)\z"))
    return F.unix_millis(F.when(iso & (F.length(said) <= 64), said).try_cast("timestamp"))


def finding(code: Column | str, path: Column | str, detail: Column | None = None) -> Column:
    detail = F.lit(None) if detail is None else detail
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), (F.col(path) if isinstance(path, str) else path).alias("path"), detail.cast("string").alias("detail"))


def findings(rows: DataFrame, *faults: Column) -> DataFrame:
    """(doc_id, code, path, detail): the faults that aren't null."""
    return rows.select("doc_id", F.explode(F.filter(F.array(*faults), lambda f: f.isNotNull())).alias("f")).select("doc_id", "f.*")


def records(rows: DataFrame, pattern: str, *fields: str) -> DataFrame:
    """(doc_id, at, fields ...): scalar fields, as text, of the objects whose paths match."""
    whole = rf"^({pattern})\.(\w+)\z"
    parts = rows.select("doc_id", F.regexp_extract("path", whole, 1).alias("at"), F.regexp_extract("path", whole, 2).alias("name"), F.coalesce("said", F.col("number").cast("string")).alias("said"))
    parts = parts.where((F.col("at") != "") & F.col("name").isin(*fields))
    return parts.groupBy("doc_id", "at").agg(*[F.max(F.when(F.col("name") == f, F.col("said"))).alias(f) for f in fields])


@dataclass(frozen=True)
class Contract:
    """``records`` has the fields of each record; a shape in ``by_kind`` is told by its field kind, as the record shape:kind."""

    records: dict[str, dict[str, str]]
    root: str
    max_bytes: int
    depth: int
    strict: bool = True
    by_kind: tuple[str, ...] = field(default=())

    def _child(self, path: Column, shape: Column, value: Column) -> Column:
        for name in self.by_kind:
            kind = F.coalesce(F.try_variant_get(value, "$.kind", "string"), F.lit(""))
            shape = F.when(shape == name, F.concat(F.lit(f"{name}:"), kind)).otherwise(shape)
        return F.struct(path.alias("path"), shape.alias("shape"), value.alias("value"), F.lit(True).alias("leaf"))

    def unread(self, documents: DataFrame, body: str = "body") -> DataFrame:
        """Findings of the texts that are over the limit, which aren't parsed, or not JSON; null is no JSON.

        Where ``documents`` has a size (see payloads), that counts, as a file over the limit has no text.
        """
        size = F.col("size") if "size" in documents.columns else F.octet_length(body)
        large = F.coalesce(size > self.max_bytes, F.lit(False))
        bad = documents.where(large | F.try_parse_json(F.when(~large, F.col(body))).isNull())
        return bad.select("doc_id", F.when(large, "too-large").otherwise("not-json").alias("code"), F.lit("$").alias("path"), F.when(large, size.cast("string")).alias("detail"))

    def rows(self, documents: DataFrame, body: str = "body") -> DataFrame:
        """(doc_id, path, shape, kind, said, number, size, keys): a row for the document and for each part that the contract knows.

        ``kind`` is the JSON type, ``size`` the length of a text in UTF-16 units or of a list, ``keys`` the fields of an object.
        Texts that are over the limit or not JSON have no rows.
        """
        text = F.when(F.octet_length(body) <= self.max_bytes, F.col(body))
        rows = documents.select("doc_id", self._child(F.lit("$"), F.lit(self.root), F.try_parse_json(text)).alias("n")).where("n.value IS NOT NULL").select("doc_id", "n.*")
        known = literal_map({f"{record}.{name.rstrip('?')}": shape for record, fields in self.records.items() for name, shape in fields.items()})
        for _ in range(self.depth):
            path, shape = F.col("path"), F.col("shape")
            in_list, in_map = F.element_at(F.split(shape, "/", 4), 4), F.element_at(F.split(shape, "/", 2), 2)
            items = F.transform(F.expr("try_cast(value AS ARRAY<VARIANT>)"), lambda x, i: self._child(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), in_list, x))
            entries = F.map_entries(F.expr("try_cast(value AS MAP<STRING, VARIANT>)"))
            named = F.transform(entries, lambda e: self._child(F.concat(path, F.lit("."), e["key"]), F.try_element_at(known, F.concat(shape, F.lit("."), e["key"])), e["value"]))
            keyed = F.transform(entries, lambda e: self._child(F.concat(path, F.lit("."), e["key"]), in_map, e["value"]))
            below = F.when(F.startswith(shape, F.lit("list/")), items).when(F.startswith(shape, F.lit("map/")), keyed).when(~F.contains(shape, F.lit("/")), F.filter(named, lambda c: c["shape"].isNotNull()))
            own = F.array(F.struct("path", "shape", "value", F.lit(False).alias("leaf")))
            none = F.filter(own, lambda c: F.lit(False))
            rows = rows.select("doc_id", F.explode(F.concat(own, F.coalesce(F.when(F.col("leaf"), below), none))).alias("n")).select("doc_id", "n.*")
        kind = F.regexp_extract(F.schema_of_variant("value"), "^[A-Z]+", 0)
        said = F.when(kind == "STRING", F.try_variant_get("value", "$", "string"))
        number = F.when(kind.isin(*_NUMBERS), F.try_variant_get("value", "$", "double"))
        size = F.coalesce((F.octet_length(F.encode(said, "UTF-16BE")) / 2).cast("int"), F.when(kind == "ARRAY", F.size(F.expr("try_cast(value AS ARRAY<VARIANT>)"))))
        keys = F.when(kind == "OBJECT", F.map_keys(F.expr("try_cast(value AS MAP<STRING, VARIANT>)")))
        return rows.select("doc_id", "path", "shape", kind.alias("kind"), said.alias("said"), number.alias("number"), size.alias("size"), keys.alias("keys"))

    def holds(self, shape: str, value: Column, but: tuple[str, ...] = ()) -> Column:
        """Whether a typed value surely keeps its shape: where true, shape_findings has nothing to say of it.

        Texts are UTF-8. Not true (false or null) proves nothing of the shapes flag, whole, digits, text? and map.
        A record's fields ``but`` some are judged.
        """
        told, *more = shape.split("/", 3)
        units = lambda: F.octet_length(F.encode(value, "UTF-16BE")) / 2
        upto = lambda most: (F.octet_length(value) <= most) | (units() <= most)  # noqa: E731  units are no more than bytes
        inside = lambda of, x: F.coalesce(self.holds(of, x), F.lit(False))
        if told in self.by_kind:
            names = [n for n in self.records if n.startswith(f"{told}:")]
            return reduce(or_, [(value["kind"] == n[len(told) + 1 :]) & self.holds(n, value) for n in names])
        if shape in self.records:
            fields = self.records[shape]
            own = {f.rstrip("?") for f in fields}
            others = {f.rstrip("?") for n, fs in self.records.items() if ":" in shape and n.startswith(shape.split(":")[0] + ":") for f in fs} - own
            every = [self.holds(of, value[f]) if not f.endswith("?") else value[f[:-1]].isNull() | self.holds(of, value[f[:-1]]) for f, of in fields.items() if f not in but]
            return reduce(and_, every + [value[f].isNull() for f in sorted(others)])
        if told == "list":
            # Instants and addresses repeat and take long to judge, so each is judged once a list.
            dear = {f: of for f, of in self.records.get(more[2], {}).items() if of in ("instant", "url")}
            each = lambda f: F.array_distinct(F.transform(value, lambda x: x[f.rstrip("?")]))
            alike = lambda f, of: F.forall(each(f), lambda v: inside(of, v) | (v.isNull() & F.lit(f.endswith("?"))))
            every = [alike(f, of) for f, of in dear.items()]
            return F.size(value).between(int(more[0]), int(more[1])) & reduce(and_, [F.forall(value, lambda x: F.coalesce(self.holds(more[2], x, tuple(dear)), F.lit(False))), *every])
        if told == "text":
            return (F.octet_length(value) >= int(more[0]) if int(more[0]) <= 1 else units() >= int(more[0])) & upto(int(more[1]))
        if told == "choice":
            return value.isin(*more[0].split("|"))
        finite = (value > float("-inf")) & (value < float("inf"))
        if told == "number":
            return finite & value.between(float(more[0]), float(more[1])) if more else finite
        if told == "reading":
            return value.isNull() | finite
        if told == "instant":
            return instant(value).isNotNull()
        if told == "url":
            return upto(2048) & F.rlike(value, F.lit(URL))
        return F.lit(False)

    def shape_findings(self, rows: DataFrame) -> DataFrame:
        """What is wrong with single values: their type, length, choice and fields."""
        shape, kind, said, number, size = (F.col(c) for c in ("shape", "kind", "said", "number", "size"))
        part = lambda n: F.try_element_at(F.split(shape, "/"), F.lit(n))
        plain = F.when(shape.isin("instant", "url", "reading", "number", "whole", "flag"), shape).otherwise("record")
        told = F.when(F.contains(shape, F.lit("/")), part(1)).otherwise(plain)
        numeric, none = kind.isin(*_NUMBERS), kind == "VOID"
        of_type = {
            "STRING": ("text", "text?", "digits", "choice", "instant", "url"),
            "ARRAY": ("list",),
            "OBJECT": ("record", "map"),
            "BOOLEAN": ("flag",),
        }
        right = (told.isin("number", "whole", "reading") & numeric) | (told.isin("reading", "text?") & none)
        for name, kinds in of_type.items():
            right |= told.isin(*kinds) & (kind == name)
        least, most = part(2).try_cast("int"), part(3).try_cast("int")
        text = told.isin("text", "text?")
        unknown_kind = F.lit(False)
        for name in self.by_kind:
            unknown_kind |= F.startswith(shape, F.lit(f"{name}:")) & ~shape.isin(*self.records) & F.array_contains("keys", F.lit("kind"))
        faults = F.array(
            F.when(~right, finding("wrong-type", "path", kind)),
            F.when(text & (size < least), finding("too-short", "path", size)),
            F.when(text & (size > most), finding("too-long", "path", size)),
            F.when((told == "digits") & ((size < least) | (size > most) | F.rlike(said, F.lit("[^0-9]"))), finding("not-digits", "path", said)),
            F.when((told == "list") & (size < least), finding("too-few", "path", size)),
            F.when((told == "list") & (size > most), finding("too-many", "path", size)),
            F.when((told == "number") & ((number < part(2).try_cast("double")) | (number > part(3).try_cast("double"))), finding("out-of-range", "path")),
            F.when((told == "whole") & ((number <= 0) | (number != F.floor(number))), finding("out-of-range", "path")),
            F.when((told == "choice") & ~F.array_contains(F.split(part(2), "\\|"), said), finding("not-allowed", "path", said)),
            F.when(unknown_kind, finding("not-allowed", F.concat("path", F.lit(".kind")), F.element_at(F.split(shape, ":", 2), 2))),
            F.when((told == "instant") & said.isNotNull() & instant(said).isNull(), finding("bad-instant", "path", said)),
            F.when((told == "url") & ((size > 2048) | ~F.rlike(said, F.lit(URL))), finding("bad-url", "path", said)),
        )
        allowed = F.try_element_at(literal_map({r: [f.rstrip("?") for f in fs] for r, fs in self.records.items()}), shape)
        required = F.try_element_at(literal_map({r: [f for f in fs if not f.endswith("?")] for r, fs in self.records.items()}), shape)
        no_finding = F.array().cast(f"array<{FINDING}>")
        each = lambda code, names: F.coalesce(F.transform(names, lambda k: finding(code, F.concat("path", F.lit("."), k))), no_finding)
        no_kind = F.when(shape.isin(*[f"{name}:" for name in self.by_kind]), F.array_except(F.array(F.lit("kind")), "keys"))
        of_fields = F.concat(each("missing-field", F.array_except(required, "keys")), each("missing-field", no_kind))
        if self.strict:
            of_fields = F.concat(each("unknown-field", F.array_except("keys", allowed)), of_fields)
        of_keys = F.transform(F.filter("keys", lambda k: F.rlike(k, F.lit("[^0-9]")) | (k == "")), lambda k: finding("not-digits", F.concat("path", F.lit("."), k), k))
        more = F.when((told == "record") & (kind == "OBJECT"), of_fields).when((told == "map") & (kind == "OBJECT"), of_keys).otherwise(no_finding)
        found = F.filter(F.concat(faults, more), lambda f: f.isNotNull())
        return rows.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")
