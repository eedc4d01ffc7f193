"""Personal data: detection and keyed surrogates.

Detected entities (mail and IPv4 addresses, phone numbers, card numbers,
IBANs, social security numbers, access keys, passwords and tokens, names
behind a title) are replaced by surrogates of the same type and format.  A name
or a password found in a text is also replaced where the text has it again
without its title or label (names of three letters or more):

* keyed: a surrogate is drawn from BLAKE2b of (key, kind, entity, attempt), so
  the same entity gets the same surrogate in every document (coreference) and
  nobody without the key can recompute it.  The parts of a name are entities of
  their own: "Mr John Smith", "Mr Smith" and "Smith" agree;
* consistent: letters become letters of the same script, case and kind
  (vowel, consonant), digits digits of the script of the mention; punctuation
  stays, but a value without any letter or digit (a masked password) becomes
  letters and digits; card numbers keep their issuer digit and check digit rule;
  given names keep the gender that the title tells; a mention keeps its own
  spelling (case, separators);
* distinct: the distinct entities of the whole table are one Spark table, and
  surrogates that two entities share, or that equal a real entity, are drawn
  again (next attempt) until there is no clash; all parts of names are held
  against each other, whatever the gender.  After ``FORM_ATTEMPTS`` attempts the
  format may be used up (there are five one-letter vowels), and each further
  attempt draws a surrogate that is longer than the one before.

Names without any title in their text are not found.  Only texts with a character that some detector needs (a native filter) reach
Python, and only those are shuffled, once, to meet their entities; a text's
entities are joined by a hash of the row, so no key is hot unless rows repeat.
Two rows whose hash clashes would share a map of entities, which is harmless:
the map is the same for all documents.

Defined cases: a null or empty text stays as it is with no entities; a null id
is allowed; repeated rows are treated alike; an empty table gives an empty
result; extra columns pass through, and names that are taken get underscores.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqlens.llm.common import free_name, give_back, let_go, ship_code, sized, small_batches, stored, tidy

DEFAULT_KEY = "surrogate-key-1"
#: draws in the entity's own format; later ones are lengthened
FORM_ATTEMPTS = 6

# Titles and the gender that they tell (fixed values).
TITLES = {
    "Mr": "m", "Mister": "m", "Herr": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Sir": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f",
    "Señora": "f", "Señorita": "f", "Sra": "f", "Srta": "f",
    "Dr": "n", "Doctor": "n", "Prof": "n", "Professor": "n", "Mx": "n",
}
GIVEN = {
    "m": ("Adrian", "Bruno", "Conrad", "Daniel", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Jonas",
          "Karl", "Leon", "Marco", "Nico", "Oscar", "Paul", "Robin", "Simon", "Thomas", "Viktor"),
    "f": ("Alba", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia",
          "Klara", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sofia", "Teresa", "Vera"),
}

_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_NAME = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
DETECT = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
    r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+)"
    r"|(?P<secret>(?<![^\W_])(?:[Pp]assword|PASSWORD|[Pp]asswd|[Pp]wd|[Tt]oken|TOKEN|[Ss]ecret|SECRET"
    r"|[Aa][Pp][Ii][_-]?[Kk]ey|API[_-]?KEY)\s?[=:]\s?[\"']?(?P<value>[^\s\"',;]{6,}))"
    r"|(?P<access>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\d|\.\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d+-])\d(?:[ -]?\d){12,18}(?![\d-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}"
    r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w]))"
    rf"|(?P<person>(?<!\w)(?:{_TITLE})\.?\ (?P<name>(?=[^\W\d_a-zß-öø-ÿ])(?:{_NAME}\ (?=[^\W\d_a-zß-öø-ÿ]))?{_NAME}))")

#: what a text needs for any detector to fire (Java regex, a superset)
MAY_HAVE = rf"[0-9@=:\p{{Nd}}]|A[KS]IA|(?=[{''.join(sorted({t[0] for t in TITLES}))}])(?:{_TITLE})\.? "
#: letters that a name needs to be replaced where no title stands before it
BARE_NAME = 3

_VOWELS = "aeiou"
_CONSONANTS = "bcdfghjklmnpqrstvwxyz"
_FREE = "abcdefghijklmnopqrstuvwxyz0123456789"
_SCRIPTS = [
    (0x00DF, 0x00FF, "àáâäèéêëìíîïòóôöùúûü"),
    (0x03B1, 0x03C9, "αβγδεζηθικλμνξοπρστυφχψω"),
    *((lo, hi, "".join(map(chr, range(lo, hi + 1)))) for lo, hi in (
        (0x0430, 0x044F), (0x05D0, 0x05EA), (0x3041, 0x3096), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))),
]


@lru_cache(maxsize=65_536)
def pool_of(ch: str) -> str:
    """What a character may become: letters of the same script, case and kind,
    digits of the same script; nothing for other characters."""
    if ch.isdecimal():
        zero = ord(ch) - unicodedata.decimal(ch)
        return "".join(chr(zero + i) for i in range(10))
    if not ch.isalpha():
        return ""
    low = ch.lower()
    if "a" <= low <= "z":
        pool = _VOWELS if low in _VOWELS else _CONSONANTS
    else:
        pool = next((p for lo, hi, p in _SCRIPTS if len(low) == 1 and lo <= ord(low) <= hi), None)
    if pool is None:
        # any other script: letters of the same category near by
        start, kind = ord(ch) & ~0x7F, unicodedata.category(ch)
        return "".join(c for c in map(chr, range(start, start + 0x80)) if unicodedata.category(c) == kind)
    return pool.upper() if ch != low else pool


class Draw:
    """Keyed stream of numbers for one (kind, entity, attempt)."""

    def __init__(self, key: str, kind: str, entity: str, attempt: int):
        self.seed = f"{kind}\x00{entity}\x00{attempt}".encode("utf-8", "surrogatepass")
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self.block, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.blake2b(self.block.to_bytes(4, "big") + self.seed, key=self.key).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n

    def like(self, text: str) -> str:
        """Every letter and digit drawn from its pool, the rest as it is; a
        text that has none to draw becomes letters and digits."""
        if all(len(pool_of(c)) < 2 for c in text):
            return "".join(_FREE[self.below(len(_FREE))] for _ in text)
        return "".join(self.one(c) for c in text)

    def one(self, ch: str) -> str:
        pool = pool_of(ch)
        return pool[self.below(len(pool))] if len(pool) > 1 else ch


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def ascii_digits(text: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def entity_of(kind: str, mention: str) -> str:
    """The entity that a mention names, free of its spelling."""
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"[^\d+]", "", ascii_digits(mention))
    if kind == "ip":
        return ascii_digits(mention)
    if kind == "iban":
        return ascii_digits(mention).replace(" ", "")
    if kind == "email":
        return mention.lower()
    return mention


def entities_of(kind: str, mention: str) -> list[tuple[str, str]]:
    """The (kind, entity) pairs of a mention: one, but for names, whose parts
    are drawn apart."""
    if kind.startswith("person:"):
        *given, family = mention.split(" ")
        return [*((f"given:{kind[-1]}", x) for x in given), ("family", family)]
    return [(kind, entity_of(kind, mention))]


def surrogate(kind: str, entity: str, key: str, attempt: int = 0) -> str:
    """Surrogate of an entity, in the entity's normal form.  From attempt
    ``FORM_ATTEMPTS`` on it is 2, 4, 8, ... characters (IP: numbers) longer
    than the format, so that there is room for any number of entities."""
    d = Draw(key, kind, entity, attempt)
    more = 2 << (attempt - FORM_ATTEMPTS) if attempt >= FORM_ATTEMPTS else 0
    if kind == "email":
        local, _, domain = entity.partition("@")
        return f"{d.like(local + '0' * more)}@{d.like(domain.split('.')[0])}.example.com"
    if kind == "ip":
        return ".".join(str(1 + d.below(254)) for _ in range(4 + more))
    if kind == "card" and luhn(entity):
        new = entity[0] + "".join(str(d.below(10)) for _ in entity[1:] + "0" * more)
        return next(c for c in (new[:-1] + str(x) for x in range(10)) if luhn(c))
    if kind in ("ssn", "card", "phone", "iban"):
        entity += "0" * more
    if kind == "ssn":
        return "".join(str(1 + d.below(9)) if i == 0 else str(d.below(10)) for i in range(len(entity)))
    if kind == "card":
        return entity[0] + "".join(str(d.below(10)) for _ in entity[1:])
    if kind == "phone":
        keep = 2 if entity.startswith("+") else 0          # the country's first digit
        return entity[:keep] + "".join(str(d.below(10)) for _ in entity[keep:])
    if kind == "iban":
        return entity[:2] + d.like(entity[2:])
    if kind == "access":
        letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
        return entity[:4] + "".join(letters[d.below(32)] for _ in entity[4:] + "A" * more)
    if kind.startswith("given:") and entity.isascii() and 2 * attempt < FORM_ATTEMPTS:
        names = GIVEN.get(kind[-1]) or GIVEN["m"] + GIVEN["f"]
        return names[d.below(len(names))]
    if kind == "family" or kind.startswith("given:"):
        return d.like(entity) + d.like(entity[-1].lower() * more)
    if re.fullmatch(r"[0-9a-f]+", entity):
        return "".join("0123456789abcdef"[d.below(16)] for _ in entity + "0" * more)
    return d.like(entity) + d.like("0" * more)


def render(kind: str, mention: str, new: str) -> str:
    """The surrogate in the spelling of the mention: its separators, and digits
    of its script."""
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(new)
        shown = "".join(c if c in " -.()" else next(chars, "") for c in mention) + "".join(chars)
    else:
        shown = new.upper() if kind == "email" and mention.isupper() else new
    if kind in ("card", "phone", "ssn", "ip", "iban") and not mention.isascii():
        zero = next((ord(c) - unicodedata.decimal(c) for c in mention if c.isdecimal() and not c.isascii()), ord("0"))
        shown = "".join(chr(zero + int(c)) if c.isascii() and c.isdecimal() else c for c in shown)
    return shown


def _titled(text: str):
    """(start, stop, kind, mention) of what the patterns find, in order."""
    for m in DETECT.finditer(text):
        kind = m.lastgroup
        if m["secret"]:
            yield *m.span("value"), "secret", m["value"]
        elif m["person"]:
            title = m["person"].split(" ")[0].rstrip(".")
            yield *m.span("name"), f"person:{TITLES[title]}", m["name"]
        else:
            yield *m.span(), kind, m[0]


def mentions(text: str):
    """(start, stop, kind, mention) of every entity of a text, in order: what
    the patterns find, and between it the names and passwords found elsewhere in
    the text."""
    found = list(_titled(text))
    again = {}
    for _, _, kind, mention in found:
        if kind == "secret":
            again[mention] = kind
        elif kind.startswith("person:"):
            for part, name in entities_of(kind, mention):
                if len(name) >= BARE_NAME:
                    again.setdefault(name, part)
    if not again:
        yield from found
        return
    bare = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(x) for x in sorted(again, key=len, reverse=True)) + r")(?!\w)")
    at = 0
    for start, stop, kind, mention in [*found, (len(text), len(text), None, None)]:
        yield from ((*m.span(), again[m[0]], m[0]) for m in bare.finditer(text, at, start) if m.end() <= start)
        if kind is not None:
            yield start, stop, kind, mention
        at = stop


def replace(text: str, known: dict[tuple[str, str], str]) -> tuple[str, list[tuple]]:
    """The text with its entities replaced, and (start, stop, kind) of each
    surrogate in the new text."""
    out, spans, at, length = [], [], 0, 0
    for start, stop, kind, mention in mentions(text):
        new = " ".join(known[e] for e in entities_of(kind, mention))
        new = render(kind, mention, new)
        out += [text[at:start], new]
        length += start - at
        spans.append((length, length + len(new), kind))
        length += len(new)
        at = stop
    out.append(text[at:])
    return "".join(out), spans


# --------------------------------------------------------------------------
# Spark
# --------------------------------------------------------------------------

def may_have(text: Column) -> Column:
    return F.coalesce(text.rlike(MAY_HAVE), F.lit(False))


def detect(rows: DataFrame) -> DataFrame:
    """(row, kind, entity) of the distinct entities of each text of (row, text)."""
    def run(batches):
        for batch in batches:
            found = [(r, k, e) for r, t in zip(batch["row"], batch["text"], strict=True)
                     for k, e in {x for _, _, k, m in mentions(t) for x in entities_of(k, m)}]
            yield pd.DataFrame(found, columns=["row", "kind", "entity"])
    return rows.mapInPandas(tidy(run), "row bigint, kind string, entity string")


def _drawn(key: str):
    @F.pandas_udf("string")
    def draw(kind: pd.Series, entity: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, e, key, a) for k, e, a in zip(kind, entity, attempt, strict=True)],
                         dtype="object")
    return draw


def assign(entities: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """(kind, entity, new): distinct surrogates for distinct entities.

    Of the entities that draw one surrogate, the least by name keeps it; the
    others, and those whose surrogate is a real entity or settled before, draw
    again.  Each round works on what clashed in the one before only; what is
    settled stays as it was written, and is only looked through."""
    ship_code(entities.sparkSession)
    draw = _drawn(key)
    real = stored(entities.select("kind", "entity").distinct(), "pii-entities")
    # all parts of names are one kind here
    sort = lambda kind: F.when(kind.rlike("^(given:.|family)$"), F.lit("name")).otherwise(kind)
    names = real.select(sort(F.col("kind")).alias("sort"), F.col("entity").alias("new"))
    pending, attempt, settled = real, 0, None
    while True:
        drawn = stored(pending.withColumn("new", draw("kind", "entity", F.lit(attempt))).withColumn(
            "sort", sort(F.col("kind"))), "pii-drawn")
        taken = names if settled is None else names.union(settled.select("sort", "new"))
        wanted = stored(drawn.select("sort", "new").distinct(), "pii-wanted")
        taken = taken.join(sized(wanted), ["sort", "new"], "left_semi").distinct().withColumn("taken", F.lit(True))
        first = F.row_number().over(Window.partitionBy("sort", "new").orderBy("entity", "kind")) == 1
        judged = stored(drawn.withColumn("first", first).join(taken, ["sort", "new"], "left").select(
            "kind", "entity", "new", "sort", (F.col("first") & F.col("taken").isNull()).alias("keeps")), "pii-surrogates")
        kept = judged.where("keeps").drop("keeps")
        settled = kept if settled is None else settled.union(kept)
        pending = judged.where("NOT keeps").select("kind", "entity")
        if pending.isEmpty():
            return settled.select("kind", "entity", "new")
        attempt += 1


def surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               key: str = DEFAULT_KEY) -> DataFrame:
    """``docs`` with the entities of its text replaced, and a column
    ``entities`` (start, stop, kind of every surrogate in the new text)."""
    ship_code(docs.sparkSession)
    cols = docs.columns
    name, row = free_name(docs, "entities"), free_name(docs, "row")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                      T.StructField("stop", T.IntegerType()),
                                      T.StructField("kind", T.StringType())]))
    text = F.col(f"`{text_col}`")
    plain = docs.where(~may_have(text)).withColumn(name, F.array().cast(spans))
    marked = docs.where(may_have(text)).withColumn(row, F.xxhash64(F.col(f"`{id_col}`"), text))
    with small_batches(docs.sparkSession):
        found = stored(detect(marked.select(F.col(row).alias("row"), text.alias("text"))).distinct(), "pii-found")
    table = assign(found, key)
    known_row, known_name = free_name(marked, "known_row"), free_name(marked, "known")
    known = found.join(table, ["kind", "entity"]).groupBy(F.col("row").alias(known_row)).agg(
        F.collect_list(F.struct("kind", "entity", "new")).alias(known_name))
    joined = marked.join(known, marked[row] == known[known_row], "left")

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", spans)]))
    def replaced(texts: pd.Series, knowns: pd.Series) -> pd.DataFrame:
        let_go()
        out = []
        for t, known_ in zip(texts, knowns, strict=True):
            if known_ is None or not len(known_):
                out.append((t, []))
                continue
            new, at = replace(t, {(k["kind"], k["entity"]): k["new"] for k in known_})
            out.append((new, [{"start": a, "stop": b, "kind": k} for a, b, k in at]))
        give_back()
        return pd.DataFrame(out, columns=["text", "spans"])

    made = free_name(joined, "made")
    with_pii = joined.withColumn(made, replaced(text, F.col(f"`{known_name}`")))
    with_pii = with_pii.select(*[F.col(made)["text"].alias(c) if c == text_col else F.col(f"`{c}`")
                                 for c in cols], F.col(made)["spans"].alias(name))
    with small_batches(docs.sparkSession):
        return stored(with_pii, "pii-replaced").unionByName(plain)
