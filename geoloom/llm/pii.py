"""PII: detected entities get keyed surrogates of their own type and shape.

Detected are e-mail addresses, IBANs, phone numbers, payment-card-like numbers, social security numbers, IP and MAC
addresses, secrets that an assignment names (token, key, password, secret) or that start like known keys, and names:
those after a title in TITLES, after words by which people introduce themselves (INTRODUCED) and under a closing line
(CLOSED), with later mentions of the same names in the text. Other names are out of reach. An entity is (kind, canonical
value): letters folded, format signs left out, so that two spellings of one phone number are one entity. A name is one
entity whatever its place, given or family.

A surrogate is a keyed hash (BLAKE2b) of the entity, spelled in its alphabet: digits stay digits, hexadecimal stays so,
card numbers keep their Luhn status and IBANs their valid check digits, given names get given names of the gender that
the title tells, family names family names, each in the script of the original; the signs and the case of the mention
are kept. The same entity gets the same surrogate in all documents: where documents disagree in a name's role, the one
that most batches of rows find holds for all. The key is a secret that the caller gives.

Distinctness is checked over all entities of the corpus, on what a reader sees: a surrogate that two entities would
share, or that is a real entity itself, is drawn again with the next attempt for all but one, until none clashes. Only
entities that clash or whose role is in doubt carry an attempt and a role, which are joined to the documents that mention
them; without such the documents are not shuffled at all.

Defined results: a null text stays null; an empty text stays empty; whole texts are read. Repeated rows are changed
alike. Columns other than text pass through, whatever they are called.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.llm._common import materialize, slices, wider

MAX_ATTEMPTS = 64

# Titles by the gender that they tell.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία"),
    "": ("Dr", "Prof"),
}
# What made-up names consist of, by script.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge gi go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe pi po ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ги го ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе пи по ра ре ри ро са се си со та те ти то ва ве ви во".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γε γι γο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πι πο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {
    "latin": {"m": "n r s l".split(), "f": "na lla ra ssa".split(), "": "x nd rt m".split(), "family": "nsen rth ldt nger".split()},
    "cyrillic": {"m": "н р с л".split(), "f": "на лла ра сса".split(), "": "м кс рт нд".split(), "family": "нов рин лев нко".split()},
    "greek": {"m": "ς".split(), "f": "να λλα ρα".split(), "": "ν ξ ρ".split(), "family": "δης κος".split()},
}

_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,}")
_GAP = r"[^\w+()]{0,6}"
_PATTERNS = (
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("phone", re.compile(rf"(?<!\w)(?:\+[0-9]{{1,3}}{_GAP})?\([0-9]{{2,4}}\){_GAP}[0-9]{{3,4}}[-. ]?[0-9]{{3,4}}(?!\w)|(?<!\w)\+[0-9]{{1,3}}(?:[-. ]?[0-9]{{2,4}}){{2,4}}(?!\w)|(?<![\w.-])[0-9]{{3}}([-. ])[0-9]{{3}}\1[0-9]{{4}}(?![\w-])")),
    ("mac", re.compile(r"(?<![\w:-])[0-9A-Fa-f]{2}(?:([:-])[0-9A-Fa-f]{2})(?:\1[0-9A-Fa-f]{2}){4}(?![\w:-])")),
    ("ipv6", re.compile(r"(?<![\w:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?:(?<=:)[0-9]{1,3}(?:\.[0-9]{1,3}){3}|:[0-9]{1,3}(?:\.[0-9]{1,3}){3})?(?![\w:]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.])[0-9](?:[ -]?[0-9]){12,18}(?![\w])")),
    ("ip", re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?!\w|\.[0-9])")),
)
_DIGITS = re.compile("[0-9]")  # no number, network address or secret is without
#: How well-known services start their keys.
_KEY_STARTS = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|sk-|xox[abpr]-|AIza|glpat-)"
_KEYS = re.compile(rf"(?<![\w-]){_KEY_STARTS}[A-Za-z0-9_\-]{{16,}}")
_SECRET = re.compile(r"(?i)(?:token|secret|passwd|password|api[_-]?key|access[_-]?key)\W{1,12}([A-Za-z0-9+/_\-]{12,})")
_TITLE = re.compile(r"\b(" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True)) + r")\b\.?((?: [^\W\d_][\w'’-]*){1,3})")
#: How people say their name, and how letters end.
INTRODUCED = ("my name is", "My name is", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo", "mi chiamo", "Mi chiamo")
CLOSED = ("Best regards", "Kind regards", "Regards", "Sincerely", "Yours sincerely", "Mit freundlichen Grüßen", "Viele Grüße", "Cordialement", "Saludos", "Atentamente", "Cordiali saluti")
_NAMES = r"((?: ?[^\W\d_][\w'’-]*){1,3})"
_INTRODUCED = re.compile(rf"\b(?:{'|'.join(INTRODUCED)}) {_NAMES}")
_CLOSED = re.compile(rf"^(?:{'|'.join(CLOSED)})[,.]?[ \t]*\n+{_NAMES}[ \t]*$", re.MULTILINE)
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
KINDS = ("email", "iban", "phone", "ssn", "card", "ip", "ipv6", "mac", "secret", "name")


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def iban_check(country: str, body: str) -> str:
    """The two check digits of an IBAN."""
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _ibans(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, str]]:
    """(start, end, canonical value): the longest part of each match, up to the end of a word, whose check digits are right."""
    m = pattern.search(text)
    while m:
        at = m.start() + 2
        for end in range(m.end(), m.start() + 14, -1):
            canon = text[m.start() : end].replace(" ", "")
            whole = text[end - 1].isalnum() and not text[end : end + 1].isalnum()
            if whole and len(canon) >= 15 and int(iban_check(canon[:2], canon[4:])) == int(canon[2:4]):
                yield m.start(), end, canon
                at = end
                break
        m = pattern.search(text, at)


def _ipv6(text: str) -> str | None:
    """The canonical form of a compressed address; None if it is none or has no digit, as names in code do."""
    try:
        return ipaddress.IPv6Address(text).compressed if _DIGITS.search(text) else None
    except ValueError:
        return None


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical value), in order and without overlaps; the earlier kind wins."""
    found: list[tuple[int, int, str, str]] = []
    starts: list[int] = []  # of what is found, in order, and where it ends
    ends: list[int] = []

    def add(a: int, b: int, kind: str, canon: str) -> None:
        i = bisect_left(starts, b)
        if not i or ends[i - 1] <= a:
            starts.insert(i, a)
            ends.insert(i, b)
            found.append((a, b, kind, canon))

    at = text.find("@")
    while at >= 0:
        a = at
        while a and text[a - 1] in _LOCAL and at - a < 64:
            a -= 1
        while a < at and text[a] in ".-%+":
            a += 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            add(a, m.end(), "email", text[a : m.end()].lower())
        at = text.find("@", at + 1)
    digits = _DIGITS.search(text)
    low = text.lower() if digits else ""
    for m in _SECRET.finditer(text) if any(x in low for x in ("token", "secret", "passw", "key")) else ():
        if any(c.isdigit() for c in m[1]):
            add(m.start(1), m.end(1), "secret", m[1])
    for m in _KEYS.finditer(text) if digits else ():
        add(m.start(), m.end(), "secret", m[0])
    for kind, pattern in _PATTERNS:
        if kind == "iban":
            for a, b, canon in _ibans(text, pattern) if digits else ():
                add(a, b, kind, canon)
            continue
        for m in pattern.finditer(text) if digits else ():
            canon = re.sub(r"[^A-Za-z0-9.]" if kind == "ip" else r"[^A-Za-z0-9]", "", m[0])
            if kind == "ipv6" and "::" in m[0]:
                canon = _ipv6(m[0])
            if canon:
                add(m.start(), m.end(), kind, canon)
    names: dict[str, str] = {}
    said = [(m[2], _GENDER[m[1]]) for m in _TITLE.finditer(text)] if any(t in text for t in _GENDER) else []
    if any(t in text for t in INTRODUCED):
        said += [(m[1], "") for m in _INTRODUCED.finditer(text)]
    if any(t in text for t in CLOSED):
        said += [(m[1], "") for m in _CLOSED.finditer(text)]
    for words, gender in said:
        parts = list(takewhile(lambda p: p[0][0].isupper(), re.finditer(r"\S+", words)))
        for i, p in enumerate(parts):
            # A name has one role in a text, so that all its mentions agree.
            names.setdefault(p[0].casefold(), f"given-{gender}" if i < len(parts) - 1 else "family")
    if names:
        for m in re.finditer(r"[^\W\d_][\w'’-]*", text):
            if m[0][0].isupper() and (role := names.get(m[0].casefold())):
                add(m.start(), m.end(), "name", f"{role}:{m[0].casefold()}")
    return sorted(found)


def _draw(key: str, kind: str, canon: str, attempt: int) -> Callable[[int], int]:
    """Numbers below n, one after the other, that the key, the entity and the attempt fix."""
    block, pool = 0, 0
    size = 1

    def next_(n: int) -> int:
        nonlocal block, pool, size
        if size < n << 64:
            data = f"{kind}\0{canon}\0{attempt}\0{block}".encode("utf-8", "surrogatepass")
            pool, size, block = int.from_bytes(hashlib.blake2b(data, key=key.encode()[:64]).digest(), "little"), 1 << 512, block + 1
        out = pool % n
        pool, size = pool // n, size // n
        return out

    return next_


def _identity(kind: str, canon: str) -> str:
    """What tells an entity from others: of a name, the name without its role."""
    return canon.split(":", 1)[1] if kind == "name" else canon


def surrogate(kind: str, canon: str, attempt: int, key: str) -> str:
    """The canonical surrogate of an entity."""
    draw = _draw(key, kind, _identity(kind, canon), attempt)
    alike = lambda c: str(draw(10)) if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"[draw(26)] if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[draw(26)] if c.isupper() else c
    if kind == "email":
        local, domain = canon.split("@", 1)
        labels = domain.split(".")
        host = _draw(key, "domain", domain, attempt)
        name = "".join(SYLLABLES["latin"][host(48)] for _ in range(3))
        parts = re.split(r"([._%+-])", local)
        new = ["".join(SYLLABLES["latin"][draw(48)] for _ in range(max(3, len(p) // 2))) if p.isalpha() else "".join(map(alike, p)) for p in parts]
        return "".join(new) + "@" + ".".join([name, *labels[max(1, len(labels) - 2) :]])
    if kind == "ip":
        return ".".join(str(1 + draw(254)) for _ in range(4))
    if kind == "iban":
        body = "".join(map(alike, canon[4:]))
        return canon[:2] + iban_check(canon[:2], body) + body
    if kind == "card":
        head = canon[0] + "".join(map(alike, canon[1:-1]))
        last = next(d for d in "0123456789" if (luhn(head + d) == 0))
        return head + (last if luhn(canon) == 0 else str((int(last) + 1 + draw(9)) % 10))
    if kind == "phone":
        return "".join(map(alike, canon)) if len(canon) < 11 else canon[:-10] + "".join(map(alike, canon[-10:]))
    if kind == "ipv6" and ":" in canon:
        return re.sub("[0-9a-f]+", lambda _: "".join("0123456789abcdef"[draw(16)] for _ in range(4)), canon)
    if kind in ("mac", "ipv6"):
        return "".join(("0123456789ABCDEF" if canon.isupper() else "0123456789abcdef")[draw(16)] for _ in canon)
    if kind == "secret" and (start := re.match(_KEY_STARTS, canon)):
        return start[0] + "".join(map(alike, canon[start.end() :]))
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", canon):
        return "".join(("0123456789ABCDEF" if canon.isupper() else "0123456789abcdef")[draw(16)] for _ in canon)
    if kind == "name":
        role, name = canon.split(":", 1)
        script = "cyrillic" if "Ѐ" <= name[0] <= "ԯ" else "greek" if "Ͱ" <= name[0] <= "Ͽ" else "latin"
        ends = ENDINGS[script]["family" if role == "family" else role.removeprefix("given-")]
        body = "".join(SYLLABLES[script][draw(len(SYLLABLES[script]))] for _ in range(3 + attempt // 8))
        return body + ends[draw(len(ends))]
    return "".join(map(alike, canon))


def render(mention: str, kind: str, new: str) -> str:
    """The surrogate in the shape of the mention: its signs, gaps and case."""
    if kind in ("email", "name"):
        letters = [c for c in mention if c.isalpha()]
        if letters and len(letters) > 1 and all(c.isupper() for c in letters):
            return new.upper()
        return new[:1].upper() + new[1:] if letters and mention[0].isupper() else new
    if kind == "ipv6" and ":" in new:
        return new.upper() if mention.isupper() else new
    if kind in ("ip", "secret"):
        return new
    signs = iter(new)
    return "".join(next(signs) if c.isalnum() else c for c in mention)


def replace(text: str | None, key: str, decided: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, dict[str, int]]:
    """The text with surrogates and the number of mentions of each kind; decided: (kind, identity) -> (canon, attempt)."""
    counts: dict[str, int] = {}
    if not text:
        return text, counts
    out, at, made = [], 0, {}
    for a, b, kind, canon in detect(text):
        own = kind, _identity(kind, canon)
        if own not in made:
            made[own] = surrogate(kind, *decided.get(own, (canon, 0)), key)
        out += [text[at:a], render(text[a:b], kind, made[own])]
        at = b
        counts[kind] = counts.get(kind, 0) + 1
    return "".join(out) + text[at:], counts


def entities(docs: DataFrame, text: str = "text", *ids: str) -> DataFrame:
    """(kind, canon, *ids) of the entities of docs, once for each batch of rows (or for each row, with ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(k, c, *i) for t, *i in zip(b.column(text).to_pylist(), *(b.column(x).to_pylist() for x in ids), strict=True) for _, _, k, c in detect(t or "")]
            rows = list(dict.fromkeys(rows))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = ["kind", "canon", *ids]
    kinds = [("kind", pa.string()), ("canon", pa.string()), *((i, pa.int64()) for i in ids)]
    schema = pa.schema(kinds)
    return docs.mapInArrow(run, ", ".join(["kind string", "canon string", *(f"{i} long" for i in ids)]))


def _named(rows: DataFrame, key: str) -> DataFrame:
    """rows (kind, own, canon, attempt) with new, the surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            new = [surrogate(*x, key) for x in zip(*(b.column(c).to_pylist() for c in ("kind", "canon", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string())], [*b.schema.names, "new"])

    return rows.select("kind", "own", "canon", "attempt").mapInArrow(run, "kind string, own string, canon string, attempt int, new string")


def _own() -> Column:
    return F.when(F.col("kind") == "name", F.expr("substring(canon, instr(canon, ':') + 1)")).otherwise(F.col("canon"))


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, own, canon, attempt, new, doubt) for each entity: the attempt at which its surrogate is its own and no real
    entity's; doubt is set where documents disagree in its role.
    """
    roles = found.groupBy("kind", _own().alias("own"), "canon").agg(F.count("*").alias("n"))
    real = roles.groupBy("kind", "own").agg(F.max_by("canon", F.struct("n", "canon")).alias("canon"), (F.count("*") > 1).alias("doubt"))
    real = materialize(real, "entities")
    now = materialize(_named(real.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(MAX_ATTEMPTS):
        owner = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "own")).alias("keep"), F.count("*").alias("n"))
        twice = owner.filter("n > 1").select("kind", "new", F.col("keep.own").alias("keep"))
        known = real.select("kind", F.col("own").alias("new"), F.lit(True).alias("real"))
        marked = now.join(twice, ["kind", "new"], "left").join(known, ["kind", "new"], "left")
        clash = F.coalesce(F.col("keep") != F.col("own"), F.lit(False)) | F.coalesce("real", F.lit(False))
        losers = materialize(marked.filter(clash).select("kind", "own", "canon", (F.col("attempt") + 1).alias("attempt")), "clashes")
        if losers.isEmpty():
            return now.join(real.filter("doubt").select("kind", "own", "doubt"), ["kind", "own"], "left").withColumn("doubt", F.coalesce("doubt", F.lit(False)))
        rest = now.join(losers.select("kind", "own"), ["kind", "own"], "left_anti").select("kind", "own", "canon", "attempt", "new")
        now = materialize(rest.union(_named(losers, key)), "surrogates")
    raise RuntimeError(f"surrogates still clash after {MAX_ATTEMPTS} attempts")


def anonymize(docs: DataFrame, key: str, *, counts: bool = False) -> DataFrame:
    """docs with surrogates in text; counts adds n_<kind> for each kind, replacing such columns."""
    if not key:
        raise ValueError("surrogates need a secret key")
    extra = [f"n_{k}" for k in KINDS] if counts else []
    keep = [c for c in docs.columns if c.lower() not in extra]
    names = [f"c{i}" for i in range(len(keep))]
    text = names[[c.lower() for c in keep].index("text")]
    rows = docs.select(*keep).toDF(*names)
    decided = attempts(entities(rows.select(text), text), key).filter("attempt > 0 OR doubt").select("kind", "own", F.col("canon").alias("as"), "attempt")
    if not decided.isEmpty():
        # Rows are matched by two hashes of the text and a spread of copies; entities are looked up by value afterwards.
        spread = F.pmod(F.xxhash64(*names), F.lit(1024)).cast("long").alias("salt")
        rows = rows.select("*", F.xxhash64(text).alias("th"), F.coalesce(F.crc32(text), F.lit(0)).alias("c"), spread)
        hits = entities(rows, text, "th", "c", "salt").withColumn("own", _own()).join(decided, ["kind", "own"])
        tries = hits.groupBy("th", "c", "salt").agg(F.collect_set(F.struct("kind", "own", "as", "attempt")).alias("tries"))
        rows = rows.join(tries.hint("shuffle_hash"), ["th", "c", "salt"], "left").select(*names, "tries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = b.column("tries").to_pylist() if "tries" in b.schema.names else [None] * b.num_rows
            done = [replace(t, key, {(x["kind"], x["own"]): (x["as"], x["attempt"]) for x in f or ()}) for t, f in zip(b.column(text).to_pylist(), found, strict=True)]
            new = pa.array([d[0] for d in done], pa.string())
            columns = [new if n == text else b.column(n) for n in names]
            numbers = [pa.array([d[1].get(k, 0) for d in done], pa.int64()) for k in KINDS] if counts else []
            yield pa.RecordBatch.from_arrays([*columns, *numbers], [*names, *extra])

    return rows.mapInArrow(run, wider(docs.select(*keep).toDF(*names), *((n, "long") for n in extra))).toDF(*keep, *extra)
