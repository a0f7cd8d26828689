"""Chains of captures of one page folded into one document that says where each of its values comes from.

The captures of a page are merged in their order, each into what the earlier ones gave. Values keep the names of the captures that they come from, whatever happens
later, so a value taken over ten times still names the first. Spark sorts the captures by page and time; a task passes over them with the state of one page, whose
size is bounded by the contract's caps, and never holds a chain. Pages are spread over tasks, one page's captures are in order and so in one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import scalars

CURRENT = "EXTENSION_DOM"
MOST_ITEMS = 20
ITEMS = ("reviews", "products")
FOLDED = """captures int, rejected int, snapshot_id string, document string, standalone boolean, field_sources map<string,array<string>>, key_sources map<string,map<string,array<string>>>, item_sources map<string,map<string,array<string>>>,
source_snapshots array<string>, first_extracted_at string, omitted_reviews int, omitted_products int, completeness double, missing_fields array<string>"""


def item_key(field: str, item: dict) -> str:
    """What tells items apart: a review's text, a product's offer or address, whatever the case."""
    if field == "reviews":
        return " ".join(str(item.get("text") or "").split()).casefold()
    return str(item.get("offer_id") or item.get("source_url") or "").casefold()


def _filled(item: dict) -> dict:
    return {k: v for k, v in item.items() if v is not None}


class Chain:
    """The state of one page: its values, and for each value, key of a map or item the captures it comes from. What a capture does not state is not touched by it."""

    def __init__(self) -> None:
        self.data, self.at, self.seen, self.extracted, self.count, self.rejected = {}, None, None, {}, 0, 0
        self.fields, self.keys, self.items, self.omitted = {}, {}, {}, dict.fromkeys(ITEMS, 0)
        self.kept, self.most = {f: [] for f in ITEMS}, 64

    def add(self, at: str, extracted_at: str | None, identity: tuple, data: dict) -> None:
        """Merges the next capture; one of another page is rejected."""
        if self.seen not in (None, identity):
            self.rejected += 1
            return
        here, cards = [at], identity[0] == "1688"
        for field in scalars.COVERAGE_FIELDS:
            now = data.get(field)
            if field in ITEMS:
                self.omitted[field] = 0
                if now:
                    self._items(field, now, at, cards and field == "reviews")
            elif now is not None:
                was = self.data.get(field)
                if isinstance(was, dict) or isinstance(now, dict):
                    self.data[field] = {**(was or {}), **(now or {})}
                    self.keys[field] = {**self.keys.get(field, {}), **dict.fromkeys(now or (), here)}
                else:
                    self.data[field], self.fields[field] = now, here
        self.seen, self.at, self.count = identity, at, self.count + 1
        self.extracted[at] = extracted_at
        if len(self.extracted) > self.most:
            used = {s for found in self.sources().values() for s in found} | {at}
            self.extracted = {k: v for k, v in self.extracted.items() if k in used}
            self.most = max(64, 2 * len(self.extracted))

    def _items(self, field: str, items: list, at: str, cards: bool) -> None:
        old, new, sources = self.kept[field], [(item_key(field, x), x) for x in items], self.items.get(field, {})
        one, now, found = dict(old), {}, {}
        for k, x in new:
            now.setdefault(k, []).append(x)
        if not (cards or "" in one or "" in now):  # each old key once, as nearly always
            for k, b in now.items():
                a = one.get(k)
                richer = a is not None and any(b[0].get(name) is None for name in a)
                found[k] = list(dict.fromkeys([*sources[k], at])) if richer else [at]
                for x in b:
                    a = x if a is None else {**a, **_filled(x)}
                one[k] = a
            kept = [p for p in one.items() if p[0] in now] + [p for p in one.items() if p[0] not in now]
            self.omitted[field] = max(0, len(kept) - MOST_ITEMS)
            self.kept[field] = kept = kept[:MOST_ITEMS]
            self.items[field] = {k: found[k] if k in now else sources[k] for k, _ in kept}
            return
        was, one = {}, {}
        for k, x in old:
            was.setdefault(k, []).append(x)
        if cards:  # as many of each text as the side with more of it
            kept = [(k, {**was[k][0], **_filled(x)} if len(was.get(k, [])) == len(now[k]) == 1 else x) for k, x in new]
            spare = {k: len(v) for k, v in now.items()}
            for k, x in old:
                if spare.get(k, 0):
                    spare[k] -= 1
                else:
                    kept.append((k, x))
        else:  # one item a key, the newer's values before the older's; items of the newer capture first
            bare = []
            for k, x in (*old, *new):
                if k:
                    one[k] = (k, {**one[k][1], **_filled(x)} if k in one else x)
                elif x not in bare:
                    bare.append(x)
                    one["", len(bare)] = (k, x)
            kept = [p for p in one.values() if p[0] in now] + [p for p in one.values() if p[0] not in now]
        self.omitted[field] = max(0, len(kept) - MOST_ITEMS)
        self.kept[field] = kept = kept[:MOST_ITEMS]
        tail = {k for k, _ in kept[len(new) :]} if cards else ()
        for k, _ in kept:
            if k not in now:
                found[k] = sources.get(k, [])
            elif k not in found:
                a, b = was.get(k, []), now[k]
                richer = bool(a) and any(b[0].get(name) is None for name in a[0])
                if cards:
                    richer = k in tail or (len(a) == len(b) == 1 and richer)
                found[k] = list(dict.fromkeys([*(sources.get(k, []) if richer else []), at]))
        self.items[field] = found

    def sources(self) -> dict[str, list[str]]:
        """The captures that each field comes from."""
        each = {f: self.items.get(f) or self.keys.get(f) for f in scalars.COVERAGE_FIELDS}
        return {f: self.fields[f] if k is None else list(dict.fromkeys(s for found in k.values() for s in found)) for f, k in each.items() if k is not None or f in self.fields}

    def row(self) -> tuple:
        import json

        name = lambda found: [CURRENT if s == self.at else f"snapshot:{s}" for s in found]
        nested = lambda x: {f: {k: name(s) for k, s in x[f].items()} for f in scalars.COVERAGE_FIELDS if f in x}
        fields = self.sources()
        data = {f: [x for _, x in self.kept[f]] or None if f in ITEMS else self.data.get(f) for f in scalars.COVERAGE_FIELDS} if self.count else {}
        used = sorted({s for found in fields.values() for s in found} - {self.at})
        first = min((self.extracted[s] for s in used if self.extracted.get(s)), default=None)
        missing = [f for f in scalars.COVERAGE_FIELDS if data.get(f) is None]
        share = round(1 - len(missing) / len(scalars.COVERAGE_FIELDS), 4)
        return (
            self.count, self.rejected, self.at, json.dumps(data, ensure_ascii=False, sort_keys=True), not used, {f: name(s) for f, s in fields.items()}, nested(self.keys), nested(self.items), used, first, *(self.omitted[f] for f in ITEMS), share, missing,
        )


def folded(captures: DataFrame) -> DataFrame:
    """One row for each page: page and FOLDED. captures: page, seq, snapshot_id, extracted_at, platform, offer_id, data (a JSON object of the contract's fields).

    Reviews and products are lists of objects, other fields values or objects. Captures whose platform or offer is not that of the page's first, and those without a
    JSON object, are counted as rejected. Equal seq are in the order of their snapshot_id. standalone: nothing of an earlier capture is left.
    """
    kind = captures.schema["page"].dataType.simpleString()
    names = ["snapshot_id", "extracted_at", "platform", "offer_id", "data"]

    def run(batches):
        import json

        import pyarrow as pa

        words = pa.list_(pa.string())
        nested = pa.map_(pa.string(), pa.map_(pa.string(), words))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.map_(pa.string(), words), nested, nested, words, pa.string(), pa.int32(), pa.int32(), pa.float64(), words]
        columns = ["captures", "rejected", "snapshot_id", "document", "standalone", "field_sources", "key_sources", "item_sources", "source_snapshots", "first_extracted_at", "omitted_reviews", "omitted_products", "completeness", "missing_fields"]
        page, state, out, of = None, None, [], None

        def pairs(x):
            return [(k, pairs(v)) for k, v in x.items()] if isinstance(x, dict) else x

        def ready():
            values = list(zip(*((p, *(pairs(v) if k in (5, 6, 7) else v for k, v in enumerate(s.row()))) for p, s in out), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(values[0], of), *(pa.array(v, t) for v, t in zip(values[1:], kinds, strict=True))], ["page", *columns])

        for batch in batches:
            of = batch.schema.field("page").type
            for owner, at, extracted, platform, offer, text in zip(*(batch.column(c).to_pylist() for c in ("page", *names)), strict=True):
                if state is None or owner != page:
                    out += [] if state is None else [(page, state)]
                    page, state = owner, Chain()
                    if len(out) >= 1024:
                        yield ready()
                        out = []
                try:
                    data = json.loads(text)
                except (TypeError, ValueError, RecursionError):
                    data = None
                if isinstance(data, dict):
                    state.add(at, extracted, (platform, offer), data)
                else:
                    state.rejected += 1
        if state is not None:
            out.append((page, state))
            yield ready()

    ordered = captures.repartition("page").sortWithinPartitions("page", "seq", "snapshot_id")
    return ordered.select("page", *(F.col(c).cast("string").alias(c) for c in names)).mapInArrow(run, f"page {kind}, {FOLDED}")


def sources(of: Column) -> Column:
    """A map of maps of sources as an array of (field, key, sources)."""
    return F.flatten(F.transform(F.map_entries(of), lambda f: F.transform(F.map_entries(f["value"]), lambda k: F.struct(f["key"].alias("field"), k["key"].alias("key"), k["value"].alias("sources")))))
