"""Personal data and secrets, replaced by keyed surrogates.

Entities are found in whole texts; each has a type and a canonical form, in which spellings of one
entity meet (digits of a number without separators, an e-mail address in lower case). A surrogate is
drawn from HMAC-SHA256 of key, type, canonical form and attempt, so that one entity has one surrogate
in the whole corpus (coreference), and it fits its type: digits stay digits, letters stay letters of
their script, card numbers and IBANs keep valid check digits, addresses stay addresses, first names
keep gender and script, and the spelling at hand (separators, case) is put on again. Names are
replaced part by part, so that "Mrs. Ada Moor" and "Mrs. Moor" stay one person, and so are the words
of the same text that repeat a part without a title. A first name has the gender that titles give it
anywhere in the corpus; if they disagree or tell none, it may get any name.

Collisions: over the table of distinct entities, a surrogate that two entities of a family share (first
names of a script, all numbers...), or that is an entity of that family in the corpus itself, is drawn
again for all but the first entity, until no collision is left. Only what collides is drawn again, and
later draws come from ever larger spaces, so rounds end. All of this is joins and aggregations over
distinct entities. Texts without anything that could be an entity are never shuffled.

Defined cases: null and empty texts stay. Equal texts are one key of the joins. Repeated rows are
replaced alike. Other columns are kept; a column named like ``count`` is replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmend.llm.common import digest, stored

# Titles before names, by gender (x: not told).
TITLES = {
    "m": "Mr Herr Herrn Monsieur Señor Signor Mister господин Господин κύριος Κύριος",
    "f": "Mrs Ms Miss Frau Mme Mlle Madame Señora Señorita Signora госпожа Госпожа κυρία Κυρία",
    "x": "Dr Prof Professor Doctor Docteur Doktor доктор Доктор профессор Профессор",
}
# Names to draw from, by gender and script.
FIRST = {
    ("m", "latin"): "Adam Bruno Carlos David Emil Felix Gustav Henry Igor Jonas Karl Louis Martin Noah Oscar Paul Robert Simon Thomas Victor",
    ("f", "latin"): "Alice Bella Clara Diana Emma Flora Greta Helen Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Teresa Vera",
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Сергей Юрий",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Светлана Юлия",
    ("m", "greek"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Θωμάς Κώστας Μιχάλης Νίκος Πέτρος Σταύρος",
    ("f", "greek"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Κατερίνα Μαρία Νίκη Σοφία",
}
LAST = {
    "latin": "Abel Barlow Castell Dorn Ebner Falk Garnier Hobbs Iversen Jansen Keller Lambert Moreno Novak Orwell Pinter Quint Rossi Santos Turner Unger Vidal Weber Yates Zeller",
    "cyrillic": "Белов Волков Громов Давыдов Ершов Жуков Зимин Королёв Лебедев Морозов Носов Орлов Павлов Рыбаков Соколов Тарасов Фролов Чернов Шубин",
    "greek": "Αθανασίου Βλάχος Γεωργίου Δούκας Ιωάννου Καραγιάννης Λάμπρου Μάρκου Νικολάου Οικονόμου Παππάς Ράλλης",
}

# Syllables of names that are coined when the lists have no name left, and endings by gender.
SYLLABLES = {"latin": ("b d f g k l m n r s t v", "a e i o u"), "cyrillic": ("б в г д к л м н р с т", "а е и о у"), "greek": ("β γ δ κ λ μ ν π ρ σ τ", "α ε ι ο υ")}
ENDINGS = {("m", "latin"): "n", ("f", "latin"): "na", ("m", "cyrillic"): "н", ("f", "cyrillic"): "на", ("m", "greek"): "νος", ("f", "greek"): "να",
           ("last", "latin"): "rd", ("last", "cyrillic"): "нов", ("last", "greek"): "νης"}

_TITLE = "|".join(sorted((re.escape(t) for names in TITLES.values() for t in names.split()), key=len, reverse=True))
_NAME = r"[^\W\d_][^\W\d_'’-]+(?:[-'’][^\W\d_]+)*"
PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<aws>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|(?:(?<![A-Za-z0-9])|(?<=[a-z])(?=[A-Z]))(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)"
    r"(?:[_-][A-Za-z0-9]{1,16}){0,2}[\"']?\s{0,8}[=:]\s{0,8}[\"']?(?P<secret>[A-Za-z0-9+/_-]{8,})"
    r"|(?P<hex>\b(?=[a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<number>(?<![\w+])\d(?:[ -]?\d){12,18}(?![\w]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,6}(?!\w)|(?<!\w)\(\d{3}\) ?\d{3}-\d{4}(?!\w)"
    r"|(?<![\w.-])\d{3}(?P<gap>[.-])\d{3}(?P=gap)\d{4}(?![\w-]|\.\d))"
    rf"|\b(?P<title>{_TITLE})\b\.?[  ](?P<person>{_NAME}(?:[  ]{_NAME}){{0,2}})"
)
_KEYWORDS = "(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)"
_INITIALS = "".join(sorted({t[0] for names in TITLES.values() for t in names.split()}))


def may_hold(text: Column) -> Column:
    """Texts for which this is false hold no entity. Each pattern begins with a class of characters that
    few places have, so that a scan is cheap."""
    secret = text.rlike("[=:]") & text.rlike(rf"{_KEYWORDS}[\w-]{{0,40}}[\"']?\s{{0,8}}[=:]")
    aws = text.contains("AKIA") | text.contains("ASIA")
    titled = text.rlike(rf"(?=[{_INITIALS}])(?<!\w)(?:{_TITLE})\b")
    return F.coalesce(text.rlike("[0-9@]") | secret | aws | titled, F.lit(False))


WORD = re.compile(_NAME)
ALPHABETS = [("a", "z"), ("а", "я"), ("α", "ω")]


def script_of(name: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", name) else "greek" if re.search("[Ͱ-Ͽ]", name) else "latin"


def luhn(digits: str) -> int:
    """The sum that is 0 modulo 10 for valid numbers."""
    values = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def family_of(kind: str) -> str:
    """What must stay distinct: names by script, whatever their gender, and all long numbers."""
    parts = kind.split(":")
    if parts[0] in ("first", "last"):
        return f"{parts[0]}:{parts[2] if parts[0] == 'first' else parts[1]}"
    return "number" if kind == "card" else kind


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, type, canonical form) from left to right. Types of names carry gender and script.
    Words that repeat a part of a titled name are names too."""
    found = list(marked_entities(text))
    parts: dict[str, tuple[str, str]] = {}
    for begin, end, kind, core in found:
        if kind.startswith(("first:", "last:")):
            parts.setdefault(text[begin:end], (kind, core))
            parts.setdefault(text[begin:end].upper(), (kind, core))
    if not parts:
        return found
    taken = {begin for begin, _, _, _ in found}
    again, k = [], 0
    for m in WORD.finditer(text):
        if m[0] in parts and m.start() not in taken:
            while k < len(found) and found[k][1] <= m.start():
                k += 1
            if k == len(found) or m.end() <= found[k][0]:
                again.append((m.start(), m.end(), *parts[m[0]]))
    return sorted(found + again) if again else found


def marked_entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The entities that are told by their form or by a title."""
    for m in PATTERN.finditer(text):
        if m["person"]:
            gender = next(g for g, names in TITLES.items() if m["title"] in names.split())
            parts = list(re.finditer(r"[^  ]+", m["person"]))
            keep = 1
            while keep < len(parts) and parts[keep][0][0].isupper():
                keep += 1
            if not parts[0][0][0].isupper():
                continue
            for k, part in enumerate(parts[:keep]):
                script = script_of(part[0])
                kind = f"last:{script}" if k == keep - 1 else f"first:{gender}:{script}"
                if script == "cyrillic" and k == keep - 1:
                    kind += ":f" if part[0].lower().endswith(("а", "я")) else ":m"
                at = m.start("person")
                yield at + part.start(), at + part.end(), kind, part[0].lower()
            continue
        kind = next(k for k in ("email", "aws", "secret", "hex", "iban", "ip", "ssn", "number", "phone") if m[k] is not None)
        value = m[kind]
        if kind in ("number", "ssn", "phone"):
            core = re.sub(r"\D", "", value)
            kind = "card" if kind == "number" and luhn(core) == 0 else kind
        elif kind == "iban":
            core = value.replace(" ", "")
            if iban_rest(core) != 1:
                continue
        elif kind == "email":
            value = value.rstrip(".-")
            core = value.lower()
        else:
            core = value
        begin = m.start() if m.lastgroup == kind or kind == "card" else m.start(kind)
        begin = text.index(value, begin)
        yield begin, begin + len(value), kind, core


class Draws:
    """A stream of numbers that follows from key, type, canonical form and attempt."""

    def __init__(self, key: bytes, kind: str, core: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{core}\0{attempt}".encode(), hashlib.sha256).digest()
        self.state, self.used = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.state < n << 64:
            self.used += 1
            self.state = int.from_bytes(hashlib.sha256(self.seed + self.used.to_bytes(4, "big")).digest(), "big")
        self.state, out = divmod(self.state, n)
        return out

    def alike(self, char: str, letters: str = "") -> str:
        """A character of the same class: digit, letter of the script and case; others stay."""
        if char in "0123456789":
            return str(self.below(10))
        if letters and char.lower() in letters:
            out = letters[self.below(len(letters))]
            return out.upper() if char.isupper() else out
        if not char.isalpha():
            return char
        for low, high in ALPHABETS:
            if low <= char.lower() <= high:
                out = chr(ord(low) + self.below(ord(high) - ord(low) + 1))
                out = "σ" if out == "ς" else out
                return out.upper() if char.isupper() else out
        return chr(ord("a") + self.below(26)) if ord(char) < 0x250 else chr(0x4E00 + self.below(5000)) if 0x4E00 <= ord(char) < 0xA000 else char


def surrogate(key: bytes, kind: str, core: str, attempt: int) -> str:
    """The replacement of a canonical form, in canonical form."""
    draws = Draws(key, kind, core, attempt)
    family = kind.split(":")[0]
    if family in ("first", "last"):
        if family == "first":
            _, gender, script = kind.split(":")
            pool = " ".join(FIRST[g, script] for g in (("m", "f") if gender == "x" else (gender,))).split()
        else:
            pool = LAST[kind.split(":")[1]].split()
        out = pool[draws.below(len(pool))]
        if attempt > 1:
            # The list is used up: names of two syllables, then three...
            gender, script = ("last", kind.split(":")[1]) if family == "last" else kind.split(":")[1:]
            first, second = (letters.split() for letters in SYLLABLES[script])
            gender = "mf"[draws.below(2)] if gender == "x" else gender
            out = "".join(first[draws.below(len(first))] + second[draws.below(len(second))] for _ in range(1 + attempt // 2)) + ENDINGS[gender, script]
        if kind.endswith("cyrillic:f"):
            out = "-".join(p + "а" if re.search("(ов|ев|ёв|ин)$", p) else p for p in out.split("-"))
        return out.lower()
    extra = "".join(str(draws.below(10)) for _ in range(attempt // 16))
    if family == "ip":
        # Parts as long as those at hand, until these addresses are used up.
        if attempt < 3:
            return ".".join(str((1 + draws.below(9), 10 + draws.below(90), 100 + draws.below(155))[len(p) - 1]) for p in core.split("."))
        return ".".join(str(1 + draws.below(254)) for _ in range(4))
    if family == "card":
        body = core[0] + "".join(draws.alike(c) for c in core[1:-1])
        return body + str(-luhn(body + "0") % 10)
    if family == "iban":
        body = "".join(draws.alike(c) for c in core[4:])
        return f"{core[:2]}{98 - iban_rest(core[:2] + '00' + body):02d}{body}"
    if family == "email":
        local, _, domain = core.rpartition("@")
        host, _, top = domain.rpartition(".")
        return "".join(draws.alike(c) for c in local) + extra + "@" + "".join(draws.alike(c) for c in host) + "." + top
    if family == "aws":
        return core[:4] + "".join("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"[draws.below(32)] for _ in core[4:])
    if family == "phone":
        # Country codes stay: the digits before the last nine or ten.
        fixed = max(0, len(core) - 10)
        return core[:fixed] + "".join(draws.alike(c) for c in core[fixed:])
    letters = "abcdef" if family == "hex" or family == "secret" and re.fullmatch("[0-9a-fA-F]+", core) else ""
    return "".join(draws.alike(c, letters) for c in core) + (extra if family == "secret" else "")


def spelled(value: str, core: str, new: str, kind: str) -> str:
    """The surrogate in the spelling of the entity at hand: its separators and its case."""
    family = kind.split(":")[0]
    if family in ("first", "last"):
        if value.isupper():
            return new.upper()
        return "-".join(p[:1].upper() + p[1:] for p in new.split("-"))
    if family == "ip" or len(core) != len(new):
        return new
    plain = iter(new)
    separators = {"number", "card", "ssn", "phone", "iban"}
    out = []
    for c in value:
        if family in separators and not c.isalnum():
            out.append(c)
            continue
        n = next(plain)
        out.append(n.upper() if c.isupper() else n)
    return "".join(out)


def replace_entities(docs: DataFrame, key: bytes, *, text: str = "text", count: str = "n_entities", most_rounds: int = 64) -> DataFrame:
    """``docs`` with surrogates in ``text``, and the number of replaced entities in ``count``."""
    kept = [c for c in docs.columns if c != count]
    # Names of our own, so that columns may be called anything.
    own = [f"c{k}" for k in range(len(kept))]
    docs = docs.select(*[docs[c].alias(name) for c, name in zip(kept, own)])
    at_text = own[kept.index(text)]
    likely = may_hold(F.col(at_text))
    digested = docs.where(likely).withColumn("digest", digest(F.col(at_text)))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d.as_py(), family_of(kind), core, kind) for d, t in zip(batch.column("digest"), batch.column("text"))
                    for kind, core in dict.fromkeys(e[2:] for e in entities(t.as_py()))]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), *(pa.array(c, pa.string()) for c in columns[1:])],
                                             names=["digest", "family", "core", "type"])

    found = stored(digested.select("digest", F.col(at_text).alias("text"))
                   .mapInArrow(detect, "digest binary, family string, core string, type string").distinct())
    chosen = distinct_surrogates(one_type(found), key, most_rounds)
    # At most as many as one text holds.
    per_text = found.select("digest", "family", "core").distinct().join(chosen, ["family", "core"]).groupBy("digest").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0000", "family", "core"), "new"))).alias("map"))
    mapped = digested.join(per_text, "digest", "left").drop("digest")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for t, pairs in zip(batch.column(at_text), batch.column("map")):
                t, known, parts, at, n = t.as_py(), dict(pairs.as_py() or ()), [], 0, 0
                for begin, end, kind, core in entities(t) if known else ():
                    parts += [t[at:begin], spelled(t[begin:end], core, known[f"{family_of(kind)}\0{core}"], kind)]
                    at, n = end, n + 1
                texts.append("".join(parts) + t[at:])
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if c == at_text else batch.column(c) for c in own] + [pa.array(counts, pa.int64())],
                names=[*own, "count"])

    schema = T.StructType([*(docs.schema[c] for c in own), T.StructField("count", T.LongType())])
    changed = mapped.mapInArrow(rewrite, schema).unionByName(docs.where(~likely).withColumn("count", F.lit(0).cast("long")))
    return changed.select(*[F.col(name).alias(c) for c, name in zip(kept, own)], F.col("count").alias(count))


def one_type(found: DataFrame) -> DataFrame:
    """(family, core, type) of every entity once. First names have the gender their titles tell, if they
    tell one."""
    told = F.regexp_extract("type", "^first:([mf]):", 1)
    genders = F.collect_set(F.nullif(told, F.lit("")))
    return found.groupBy("family", "core").agg(genders.alias("genders"), F.min("type").alias("type")).select(
        "family", "core", F.when(F.col("family").startswith("first:"), F.concat(
            F.lit("first:"), F.when(F.size("genders") == 1, F.element_at("genders", 1)).otherwise("x"),
            F.regexp_extract("family", "(:.*)", 1))).otherwise(F.col("type")).alias("type"))


def distinct_surrogates(known: DataFrame, key: bytes, most_rounds: int = 64) -> DataFrame:
    """(family, core, new) for distinct (family, core, type): no two of a family share a surrogate, and none
    is a canonical form of that family in the corpus."""
    known = stored(known.select("family", "core", "type"))

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["family", "core", "type", "attempt"]
        for batch in batches:
            new = [surrogate(key, k, c, a) for k, c, a in zip(*(batch.column(n).to_pylist() for n in ("type", "core", "attempt")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(new, pa.string())], names=[*names, "new"])

    real = known.select("family", F.col("core").alias("new"), F.lit(True).alias("real"))
    settled = None
    pending = known.withColumn("attempt", F.lit(0))
    for _ in range(most_rounds):
        drawn = stored(pending.mapInArrow(draw, "family string, core string, type string, attempt int, new string"))
        # Of those that drew the same, the first keeps it; whatever was kept in a round before stays.
        first = drawn.groupBy("family", "new").agg(F.min("core").alias("owner"))
        judged = drawn.join(first, ["family", "new"]).join(real, ["family", "new"], "left")
        lost = F.coalesce(F.col("real"), F.lit(False)) | (F.col("owner") != F.col("core"))
        if settled is not None:
            judged = judged.join(settled.select("family", "new", F.lit(True).alias("taken")), ["family", "new"], "left")
            lost = lost | F.coalesce(F.col("taken"), F.lit(False))
        judged = stored(judged.withColumn("lost", lost).select(*drawn.columns, "lost"))
        kept = judged.where("NOT lost").select("family", "core", "new")
        settled = kept if settled is None else settled.unionByName(kept)
        pending = judged.where("lost").select("family", "core", "type", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return settled
    raise ValueError(f"surrogates still collide after {most_rounds} rounds")
