"""Private data to surrogates (operator 2).

Detected: e-mail addresses, phone, card, social-security and bank account numbers, IP addresses, secrets
(access keys, tokens, passwords) and names after a title, whose later mentions without it are found too.
Each entity gets a surrogate of its type and format (:mod:`gridloom.llm.surrogates`), the same for every
mention in every document (coreference) and a different one for different entities (distinctness).

1. One scan lists the distinct entities of all documents (combined before the shuffle).
2. Surrogates are computed per entity and checked over the whole corpus as they are written, given and family names of both
   genders together: none may equal another's nor any real value of its kind. Of those that want the same the first one
   gets it; the others, and only they, go on to their next attempt until none is left.
3. One more scan rewrites the documents. The surrogate is a function of key, entity and attempt, so nothing has to be
   joined but the attempts above zero: a handful, broadcast if they are under ``BROADCAST_ROWS``, else joined per document.

One entity: a phone number with and without its calling code or trunk zero, an address of either kind in any writing, a card or
account number with any gaps, a name in any case with one gender. Not found: names that follow no title in their document (an
untitled full name, a surname whose title stands in another document), numbers without the shapes below, IPv6 addresses with
"::". Titles that tell no gender count as male unless the name also follows one that does.

Surrogates may coincide with common words of the text: only detected values are compared. Defined results: null
text stays null, empty text empty; mentions that overlap are taken by place, then length; repeated rows and rows without an id are
rewritten each; other columns pass through whatever their names: the list of replacements is the last column, ``replaced`` or,
where that name is taken, the first free one of ``replaced_``, ``replaced__``...; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import free, materialize
from .surrogates import Keyed, calling_code, luhn, refill, surrogate
from .textops import lean, slices

BROADCAST_ROWS = 100_000
#: titles and the gender they tell; "" where they tell none (then the given name's form decides nothing and m is taken)
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
          "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Srta": "f", "Signor": "m", "Signora": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f",
          "Dr": "", "Prof": "", "Professor": "", "Doctor": "", "Doktor": "", "Docteur": "", "Professeur": "", "Dott": "", "Dottor": "", "Доктор": "", "Профессор": "", "Δρ": "", "Καθηγητής": "m", "Καθηγήτρια": "f"}
#: combining marks, which belong to the letters before them
_MARKS = "".join(re.escape(chr(c)) for c in range(0x300, 0x1100) if unicodedata.category(chr(c))[0] == "M")
_LETTERS = rf"(?:[^\W\d_]|[{_MARKS}])+"
_NAME = rf"[^\W\d_a-zа-яα-ω]{_LETTERS}(?:-{_LETTERS})?"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w])|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
CARD = r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"
SSN = r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
IP6 = r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"
KEY = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])"
SECRET = r"(?i:(?<![a-z0-9])(?:[a-z]+[_-])?(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b[\"']? *[=:] *[\"']?)(?P<value>[^\s\"',;]{6,})"
PATTERNS = [("email", EMAIL), ("secret", KEY), ("secret", SECRET), ("iban", IBAN), ("ip6", IP6), ("ip", IP), ("ssn", SSN), ("phone", PHONE), ("card", CARD)]
_COMPILED = [(kind, re.compile(p)) for kind, p in PATTERNS]
_TITLED = re.compile(r"(?<!\w)((?:(?:" + "|".join(TITLES) + r")\.? )+)((?:" + _NAME + r" ){0,2}" + _NAME + ")")
#: what a text must have to be looked at (RE2, whose \b and \w are ASCII only): each detector's matches have one of these
_LOOK = (r"[\p{Nd}@]|(?:[0-9A-Fa-f]{1,4}:){7}|AKIA[0-9A-Z]{16}|(?i:token|secret|password|passwd|pwd|key)[\"']? *[=:]|(?:^|[^0-9A-Za-z_])(?:" + "|".join(TITLES) + r")\.? ")


def decimal(s: str) -> str:
    """The digits of ``s``, of any script, as 0 to 9."""
    return "".join(str(unicodedata.decimal(c)) for c in s if c.isdecimal())


def phone_parts(found: str) -> tuple[str, str, str]:
    """(calling code, trunk zero, number) of the digits of a phone number; the first two may be empty."""
    digits = decimal(found)
    code = calling_code(digits) if found.startswith("+") else ""
    rest = digits[len(code):]
    return code, rest[:1] if rest.startswith("0") else "", rest.removeprefix("0")


def normal(kind: str, found: str) -> str | None:
    """An entity's normal form; None: not one after all."""
    digits = decimal(found)
    if kind == "email":
        return found.lower()
    if kind == "phone":
        rest = phone_parts(found)[2]
        return f":{rest}" if len(rest) >= 7 else None
    if kind == "card":
        return digits if 13 <= len(digits) <= 19 and (digits[0] in "23456" or luhn(digits[:-1]) == int(digits[-1])) else None
    if kind == "ssn":
        return digits
    if kind == "ip":
        return ".".join(str(int(x)) for x in found.split("."))
    if kind == "ip6":
        return ":".join(f"{int(x, 16):04x}" for x in found.split(":"))
    if kind == "iban":
        s = found.replace(" ", "")
        return s if 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 else None
    return found


def as_found(kind: str, found: str, value: str) -> str:
    """``value`` (a surrogate's normal form) written as ``found`` is written."""
    if kind == "phone":
        code, trunk, _ = phone_parts(found)
        return refill(found, code + trunk + value.partition(":")[2])
    if kind in ("card", "ssn"):
        return refill(found, value)
    if kind == "iban":
        it = iter(value)
        return "".join(c if c == " " else next(it) for c in found)
    if kind == "ip6":
        whole = any(len(x) > 1 and x[0] == "0" for x in found.split(":")) or all(len(x) == 4 for x in found.split(":"))
        value = value if whole else ":".join(f"{int(x, 16):x}" for x in value.split(":"))
        return value.upper() if any(c.isupper() for c in found) else value
    if kind in ("given", "family"):
        word = value.partition(":")[2]
        return word.upper() if found.isupper() and len(found) > 1 else "-".join(x[:1].upper() + x[1:] for x in word.split("-"))
    if kind == "email" and len(found) == len(value):
        return "".join(v.upper() if c.isupper() else v for c, v in zip(found, value, strict=True))
    return value


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the private strings of ``text``, in order, none overlapping."""
    found = []
    for kind, p in _COMPILED:
        for m in p.finditer(text):
            b, e = m.span("value") if "value" in p.groupindex else m.span()
            if (norm := normal(kind, text[b:e])) is not None:
                found.append((b, -e, kind, norm))
    people: dict[str, str] = {}  # word -> kind and normal form, for mentions without a title
    titled = [(next(filter(None, (TITLES[t.rstrip(".")] for t in m[1].split())), ""), m[2].split(" ")) for m in _TITLED.finditer(text)]
    for gender, words in sorted(titled, key=lambda x: not x[0]):  # titles that tell a gender decide
        for n, w in enumerate(words):
            kind = "family" if n == len(words) - 1 else "given"
            people.setdefault(w, f"{kind}\x1f{gender or 'm'}:{w.lower()}")
    if people:
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(people, key=len, reverse=True))) + rf")(?![\w{_MARKS}])", text):
            kind, _, norm = people[m[0]].partition("\x1f")
            found.append((m.start(), -m.end(), kind, norm))
    out, last = [], 0
    for b, e, kind, norm in sorted(found):
        if b >= last:
            out.append((b, -e, kind, norm))
            last = -e
    return out


def rewrite(text: str, key: Keyed, attempts: dict[tuple[str, str], int]) -> tuple[str, list[tuple[str, str, str]]]:
    """(text with surrogates, (kind, mention, replacement) in order)."""
    out, done, at = [], [], 0
    for b, e, kind, norm in mentions(text):
        new = as_found(kind, text[b:e], surrogate(key, kind, norm, attempts.get((kind, norm), 0)))
        out += [text[at:b], new]
        done.append((kind, text[b:e], new))
        at = e
    return "".join([*out, text[at:]]), done


def _strings(col: pa.Array) -> pa.Array:
    return col.cast(pa.large_string())


def find_entities(docs: DataFrame, by_doc: bool = False) -> DataFrame:
    """kind, norm (distinct), or doc_id, kind, norm per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            texts = _strings(batch.column(1))
            look = np.flatnonzero(pc.match_substring_regex(texts.fill_null(""), _LOOK).to_numpy(zero_copy_only=False))
            own = batch.column(0).to_pylist() if by_doc else None
            rows = dict.fromkeys((own[i] if by_doc else 0, kind, norm) for i in look.tolist() for _, _, kind, norm in mentions(texts[i].as_py()))
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "kind", "norm"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, kind string, norm string")
    return rows if by_doc else rows.select("kind", "norm").distinct()


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, attempt) of the entities whose surrogate at attempt 0 collides. ``entities`` is a table of distinct ones."""
    is_name = F.col("kind").isin("given", "family")
    place = F.when(is_name, "name").otherwise(F.col("kind")).alias("place")
    shown = lambda c: F.when(is_name, F.substring(c, 3, 1 << 30)).otherwise(F.col(c)).alias("shown")  # noqa: E731  a name is written without the gender before it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = Keyed(key)
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(k, a, b, n) for a, b, n in zip(*cols, strict=True)], pa.string())], names=["kind", "norm", "attempt", "made"])

    taken = materialize(entities.select(place, shown("norm")).distinct(), "pii-real")
    moving, raised = entities.select("kind", "norm", F.lit(0).alias("attempt")), []
    while True:
        made = materialize(moving.mapInArrow(run, "kind string, norm string, attempt int, made string").select("kind", "norm", "attempt", place, shown("made")), "pii-surrogates")
        first = made.join(taken, ["place", "shown"], "left_anti").groupBy("place", "shown").agg(F.min(F.struct("kind", "norm", "attempt")).alias("w"))
        won = materialize(first.select("place", "shown", "w.*"), "pii-settled")
        raised.append(won.where("attempt > 0").select("kind", "norm", "attempt"))
        moving = materialize(made.join(won, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "pii-moving")
        if not moving.take(1):
            return reduce(DataFrame.unionByName, raised)
        taken = taken.unionByName(won.select("place", "shown"))


def pseudonymize(docs: DataFrame, key: bytes = b"gridloom") -> DataFrame:
    """``docs`` with its ``text`` rewritten and, last, a column ``replaced`` (array of kind, original, surrogate)."""
    into, hint, other = free(docs.columns, "replaced"), free(docs.columns, "_raised"), free(docs.columns, "_d")
    raised = materialize(settle(materialize(find_entities(docs), "pii-entities"), key), "pii-raised")
    few = raised.count() <= BROADCAST_ROWS
    if few:
        attempts = {(r.kind, r.norm): r.attempt for r in raised.collect()}
        rows = docs.withColumn(hint, F.lit(None).cast("array<struct<kind:string,norm:string,attempt:int>>"))
    else:
        attempts = {}
        own = find_entities(docs, by_doc=True).join(raised, ["kind", "norm"]).groupBy("doc_id").agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias(hint))
        own = own.withColumnRenamed("doc_id", other)
        rows = docs.join(own, docs["doc_id"].eqNullSafe(own[other]), "left").drop(other)
    at = rows.columns.index("text")
    kinds = "array<struct<kind:string,original:string,surrogate:string>>"
    out = pa.list_(pa.struct([("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        k = Keyed(key)
        for whole in batches:
            if not whole.num_rows:
                continue
            texts = _strings(whole.column(at))
            for i, j in slices(texts.fill_null(""), 8_000_000):
                batch, part = whole.slice(i, j - i), texts.slice(i, j - i)
                look = np.flatnonzero(pc.match_substring_regex(part.fill_null(""), _LOOK).to_numpy(zero_copy_only=False)).tolist()
                changed: dict[int, str] = {}
                done: list[list[dict]] = [[] for _ in range(len(part))]
                for n in look:
                    own = attempts | {(x["kind"], x["norm"]): x["attempt"] for x in batch.column(batch.num_columns - 1)[n].as_py() or ()}
                    text, list_ = rewrite(part[n].as_py(), k, own)
                    if list_:
                        changed[n] = text
                        done[n] = [dict(zip(("kind", "original", "surrogate"), x, strict=True)) for x in list_]
                if changed:
                    mask = np.zeros(len(part), bool)
                    mask[list(changed)] = True
                    part = pc.replace_with_mask(part, pa.array(mask), pa.array(list(changed.values()), pa.large_string()))
                cols = list(batch.columns)[:-1]
                cols[at] = part.cast(pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(done, out)], names=[*batch.schema.names[:-1], into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return rows.select(*[f"`{c}`" for c in docs.columns], hint).withColumn("text", F.col("text").cast("string")).mapInArrow(run, f"{schema}, `{into}` {kinds}")
