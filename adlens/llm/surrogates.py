"""PII surrogates: keyed, type-consistent replacements for detected entities.

An entity is a kind and a canonical value, so all spellings of it get the
same surrogate everywhere (coreference).  Surrogates come from an HMAC of key,
kind, value and attempt.  A check over the whole corpus keeps them distinct: an entity
whose surrogate another entity has, or which is itself a value that occurs,
draws again until none is left.  Only redrawn entities have to be looked up when the
texts are rewritten; all others are recomputed from the key.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adlens.llm.common import join_salted, save, text_batches

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): ("Anna Maria Laura Julia Sophie Emma Clara Elena Marta Alice Nina Paula Irene Diana Helen Susan "
                     "Linda Karen Lisa Sarah").split(),
    ("latin", "m"): ("Peter Paul Martin Thomas Daniel David Robert Michael John James Carlos Pedro Luis Hans Klaus "
                     "Pierre Louis Marc Simon Oscar").split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Татьяна Наталья Светлана Юлия Екатерина".split(),
    ("cyrillic", "m"): "Иван Пётр Алексей Сергей Дмитрий Андрей Михаил Николай Павел Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Αικατερίνη Σοφία Άννα Γεωργία".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
}
SYLLABLES = {
    "latin": "ba be da do fe ga ha ka ko la le lo ma me mi na no ra re ri ro sa se so ta te to va ve vi".split(),
    "cyrillic": "ба ве га да ко ла ле ма ми на но ра ре ро са со та те то ва".split(),
    "greek": "βα γε δα κο λα λε μα μι να νο ρα ρε ρο σα σο τα τε το".split(),
}
_POOL = {n.casefold(): group for group, names in GIVEN.items() for n in names}
_NAMES = "|".join(re.escape(x) for names in GIVEN.values() for n in names for x in (n, n.upper()))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERN = re.compile(
    r"(?P<email>[^\W_][\w.%+-]*@[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)*\.[^\W\d_]{2,})"
    r"|(?P<hex>(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    rf"|(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w.])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d))"
    rf"|(?P<person>(?<!\w)(?:{_NAMES})(?: [^\W\d_][\w'-]+)?(?!\w))")
_HINT = re.compile(rf"[\d@]|(?<!\w)(?:{_NAMES})(?!\w)")


def _script(word: str) -> str:
    name = unicodedata.name(word[0], "") if word else ""
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def find_entities(text: str):
    """(start, end, kind, canonical value) of the entities, in order.  A person
    is a given name and, if the next word is capitalised, a surname, as entities of
    their own, so that either part is replaced alike wherever it stands."""
    if not _HINT.search(text):
        return
    for m in PATTERN.finditer(text):
        kind, s = m.lastgroup, m[0]
        if kind == "person":
            given, _, rest = s.partition(" ")
            yield m.start(), m.start() + len(given), "given", given.casefold()
            if rest and rest[0].isupper() and rest.casefold() not in _POOL:
                yield m.start() + len(given) + 1, m.end(), "surname", rest.casefold()
        elif kind in ("phone", "card", "ssn"):
            yield m.start(), m.end(), kind, re.sub(r"\D", "", s)
        elif kind == "iban":
            yield m.start(), m.end(), kind, s.replace(" ", "")
        else:
            yield m.start(), m.end(), kind, s.lower()


class _Draws:
    """A stream of numbers fixed by the key and the entity."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest()
        self.n, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        head, self.pool = self.pool[:4], self.pool[4:]
        return int.from_bytes(head, "big") % n


def _like(value: str, draws: _Draws, letters: str = "abcdefghijklmnopqrstuvwxyz") -> str:
    """Digits for digits and letters for letters; anything else stays."""
    return "".join(str(draws.below(10)) if c.isdigit() else
                   letters[draws.below(len(letters))] if c.isalpha() and c.islower() else
                   letters[draws.below(len(letters))].upper() if c.isalpha() else c for c in value)


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of an entity."""
    d = _Draws(key, kind, value, attempt)
    if kind == "given":
        pool = sorted(GIVEN[_POOL[value]], key=lambda n: hmac.new(key, n.encode(), hashlib.sha256).digest())
        at = [n.casefold() for n in pool].index(value)  # one keyed cycle: distinct, and never the name itself
        return pool[(at + 1) % len(pool)]
    if kind == "surname":
        syllables = SYLLABLES[_script(value)]
        return "".join(syllables[d.below(len(syllables))] for _ in range(max(3, (len(value) + 1) // 2 + attempt // 4)))
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4))
    if kind == "hex":
        return "".join("0123456789abcdef"[d.below(16)] for _ in value)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        body, _, top = domain.rpartition(".")
        return f"{_like(local, d)}@{_like(body, d)}.{top}"
    if kind == "iban":
        return value[:2] + _like(value[2:], d)
    if kind == "phone":
        keep = 0 if len(value) <= 10 else len(value) - 10  # the country code
        return value[:keep] + _like(value[keep:], d)
    return _like(value, d)


def in_format(original: str, kind: str, canonical: str) -> str:
    """The canonical surrogate written like the original: its separators and
    its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        rest = iter(canonical)
        return "".join(next(rest) if c.isalnum() else c for c in original)
    if kind in ("given", "surname"):
        if original.isupper():
            return canonical.upper()
        return canonical[:1].upper() + canonical[1:] if original[:1].isupper() else canonical
    if len(canonical) == len(original):
        return "".join(c.upper() if o.isupper() else c for c, o in zip(canonical, original))
    return canonical


def replace_entities(text: str, key: bytes, redrawn: dict) -> tuple[str, dict]:
    """(text with surrogates, number of entities by kind)."""
    out, at, seen = [], 0, {}
    for start, end, kind, value in find_entities(text):
        new = surrogate(key, kind, value, redrawn.get((kind, value), 0))
        out += [text[at:start], in_format(text[start:end], kind, new)]
        at = end
        seen[kind] = seen.get(kind, 0) + 1
    out.append(text[at:])
    return "".join(out), seen


def draw_surrogates(entities: DataFrame, key: bytes, rounds: int = 64) -> DataFrame:
    """(kind, value, attempt, surrogate): distinct within a kind, and none of
    them a value of ``entities`` (distinct kind, value)."""

    def draw(batches):
        for batch in batches:
            kinds, values, attempts = (batch.column(i).to_pylist() for i in range(3))
            new = [surrogate(key, k, v, a) for k, v, a in zip(kinds, values, attempts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(new, pa.string())],
                                             ["kind", "value", "attempt", "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    entities = save(entities, "pii-entities")
    fixed = entities.where("kind = 'given'").withColumn("attempt", F.lit(0)).mapInArrow(draw, schema)
    todo = entities.where("kind <> 'given'").withColumn("attempt", F.lit(0))
    drawn = save(todo.mapInArrow(draw, schema), "pii-drawn")
    real = entities.select("kind", F.col("value").alias("surrogate"))
    for _ in range(rounds):
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "value"))
        shared = drawn.withColumn("r", first).where("r > 1").select("kind", "value")
        taken = drawn.join(real, ["kind", "surrogate"], "left_semi").select("kind", "value")
        bad = save(shared.unionByName(taken).distinct(), "pii-bad")
        if bad.isEmpty():
            return drawn.unionByName(fixed)
        again = drawn.join(bad, ["kind", "value"], "left_semi").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        drawn = save(drawn.join(bad, ["kind", "value"], "left_anti").unionByName(again.mapInArrow(draw, schema)), "pii-drawn")
    raise ValueError("surrogates still collide: the kinds have too few values")


def replace_pii(df: DataFrame, key: str = "adlens", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities, kinds
    (number by kind).

    Null text stays null with no entity; empty texts stay empty.  Null ids and
    repeated rows are rewritten like others, and equal texts alike.  An empty table gives
    an empty result.  Other columns are ignored.
    """
    secret = key.encode()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def detect(batches):
        for batch in batches:
            seen = {(k, v) for t in batch.column(0).to_pylist() if t for _, _, k, v in find_entities(t)}
            if seen:
                kinds, values = zip(*sorted(seen))
                yield pa.RecordBatch.from_pydict({"kind": list(kinds), "value": list(values)})

    entities = rows.select("text").mapInArrow(detect, "kind string, value string").distinct()
    drawn = draw_surrogates(entities, secret)
    redrawn = save(drawn.where("attempt > 0").select("kind", "value", "attempt"), "pii-redrawn")
    hint = F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>")
    if redrawn.isEmpty():
        work = rows.withColumn("hints", hint)
    else:
        keyed = rows.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))

        def mentions(batches):
            for batch in batches:
                got = [(k, *e) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t
                       for e in sorted({(kind, v) for _, _, kind, v in find_entities(t)})]
                if got:
                    keys, kinds, values = zip(*got)
                    yield pa.RecordBatch.from_pydict({"key": list(keys), "kind": list(kinds), "value": list(values)})

        named = keyed.select("key", "text").mapInArrow(mentions, "key binary, kind string, value string")
        named = named.withColumn("entity", F.struct("kind", "value"))
        lookup = redrawn.select(F.struct("kind", "value").alias("entity"), "attempt")
        hints = save(join_salted(named, lookup, "entity", ["key"], "inner").groupBy("key").agg(
            F.collect_set(F.struct("kind", "value", "attempt")).alias("hints")), "pii-hints")
        work = join_salted(keyed, hints, "key", ["id"], "left").select("id", "text", "hints")
    kinds = pa.map_(pa.string(), pa.int64())
    id_type = df.schema[id_col].dataType.simpleString()

    def rewrite(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                texts, hints = part.column(1).to_pylist(), part.column(2).to_pylist()
                for a, b in text_batches([t or "" for t in texts], 16_000_000):
                    done = [(None, {}) if t is None else replace_entities(
                        t, secret, {(h["kind"], h["value"]): h["attempt"] for h in hs or ()})
                        for t, hs in zip(texts[a:b], hints[a:b])]
                    yield pa.RecordBatch.from_arrays([
                        part.column(0).slice(a, b - a), pa.array([t for t, _ in done], pa.string()),
                        pa.array([sum(s.values()) for _, s in done], pa.int64()),
                        pa.array([sorted(s.items()) for _, s in done], kinds)],
                        ["id", "text", "n_entities", "kinds"])

    out = work.mapInArrow(rewrite, f"id {id_type}, text string, n_entities long, kinds map<string,long>")
    return out.withColumnRenamed("id", id_col)
