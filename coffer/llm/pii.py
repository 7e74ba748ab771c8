"""Personal data replaced by keyed surrogates of the same kind, script and format."""

import hashlib
import hmac
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .common import materialize, small_batches

# Forms of address by gender, and given names by gender and script.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Doña", "Госпожа"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"],
    "n": ["Dr", "Prof", "Professor"],
}
GIVEN = {
    ("f", "latin"): ["Anna", "Maria", "Elena", "Clara", "Julia", "Laura", "Sofia", "Nora", "Lena",
                     "Alice", "Emma", "Ida"],
    ("m", "latin"): ["Paul", "Martin", "Thomas", "Lukas", "Daniel", "Oscar", "Felix", "Adrian",
                     "Victor", "Simon", "Hugo", "Emil"],
    ("n", "latin"): ["Robin", "Kim", "Sascha", "Alex", "Noel", "Jules", "Andrea", "Nikola"],
    ("f", "cyrillic"): ["Анна", "Мария", "Елена", "Ольга", "Вера", "Нина"],
    ("m", "cyrillic"): ["Иван", "Павел", "Андрей", "Олег", "Борис", "Фёдор"],
    ("n", "cyrillic"): ["Саша", "Женя", "Валя", "Слава"],
}
SYLLABLES = {
    "latin": ["ba", "den", "for", "gal", "hol", "kin", "lor", "mar", "nes", "ost", "pel", "ram",
              "sol", "tor", "ven", "wil"],
    "cyrillic": ["ба", "ден", "вор", "гал", "кин", "лор", "мар", "нес", "пол", "рам", "сол", "тор"],
}

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
ENTITY = re.compile(
    r"(?P<email>[A-Za-z0-9À-ÿ._%+-]+@[A-Za-z0-9À-ÿ-]+(?:\.[A-Za-z0-9À-ÿ-]+)*\.[A-Za-z]{2,})"
    r"|(?P<secret>(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"
    r"|(?<=[=:])\s?[\"'][A-Za-z0-9_+/=-]{20,}[\"'])"
    rf"|(?P<ip>(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d)(?!\.\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<phone>(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    rf"|(?P<person>\b(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}})")
#: a text without any of these holds no entity
HINT = re.compile(rf"[@\d]|\b(?:{_TITLE})\b|[0-9a-fA-F]{{32}}|[=:]\s?[\"']")


def _key_bytes(key):
    return key.encode() if isinstance(key, str) else key


class _Stream:
    """Keyed pseudo-random choices for one entity."""

    def __init__(self, key, kind, canon, attempt):
        self.key, self.seed = key, f"{kind}\0{canon}\0{attempt}".encode()
        self.block, self.left = 0, b""

    def below(self, n):
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.block.to_bytes(4, "big"),
                                  hashlib.sha256).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return value % n


def canonical(kind, value):
    """What makes two mentions the same entity: case, separators and title forms do not."""
    if kind in ("email", "secret"):
        return value.strip(" \"'").casefold()
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "person":
        title, _, name = value.partition(" ")
        return f"{_gender(title)} {' '.join(name.split())}"
    return value


def _gender(title):
    return next(g for g, names in TITLES.items() if title.rstrip(".") in names)


def _luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d)
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10


def _like(stream, text, hexadecimal=False):
    """Each letter by a letter of its case and script, each digit by a digit."""
    out = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[stream.below(16)])
        elif c.isdigit():
            out.append(str(stream.below(10)))
        elif "a" <= c.lower() <= "z" or "à" <= c.lower() <= "ÿ":
            new = "abcdefghijklmnopqrstuvwxyz"[stream.below(26)]
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def surrogate(key, kind, canon, attempt=0):
    """Canonical surrogate of a canonical entity; the same key gives the same surrogate.

    After a few attempts letters are added, so that even a crowded format runs out of clashes.
    """
    s = _Stream(_key_bytes(key), kind, canon, attempt)
    more = "a" * max(0, attempt - 3)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        *labels, top = domain.split(".")
        return f"{_like(s, local + more)}@{'.'.join(_like(s, x) for x in labels)}.{top}"
    if kind == "secret":
        return _like(s, canon + more, all(c in "0123456789abcdef" for c in canon))
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "person":
        gender, _, name = canon.partition(" ")
        script = "cyrillic" if re.search("[а-яё]", name) else "latin"
        parts = name.split(" ")
        made = [_choose(s, GIVEN[gender, script])] if len(parts) > 1 else []
        while len(made) < len(parts):
            made.append("".join(_choose(s, SYLLABLES[script]) for _ in range(4 + len(more))).capitalize())
        return f"{gender} {' '.join(made)}"
    if kind == "iban":
        return canon[:2] + _like(s, canon[2:])
    if kind == "card":
        body = canon[0] + "".join(str(s.below(10)) for _ in canon[1:])
        valid = _luhn(canon) == 0
        check = next(d for d in "0123456789" if (_luhn(body[:-1] + d) == 0) == valid)
        return body[:-1] + (check if valid or _luhn(body) == 0 else body[-1])
    keep = max(0, len(canon) - 10) if kind == "phone" else 0
    body = str(1 + s.below(8)) + "".join(str(s.below(10)) for _ in canon[keep + 1:])
    return canon[:keep] + body


def _choose(stream, names):
    return names[stream.below(len(names))]


def render(kind, made, mention):
    """A canonical surrogate in the mention's own separators, quotes, case and title."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(made)
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        chars = iter(made)
        return "".join(c if c == " " else next(chars) for c in mention)
    if kind == "person":
        return f"{mention.partition(' ')[0]} {made.partition(' ')[2]}"
    if kind in ("email", "secret"):
        body = mention.strip(" \"'")
        new = made.upper() if body.isupper() else made
        return mention.replace(body, new)
    return made


def find_entities(text):
    """(kind, canonical value, first, last) of every entity of a text, left to right."""
    if not HINT.search(text):
        return []
    return [(m.lastgroup, canonical(m.lastgroup, m[0]), m.start(), m.end())
            for m in ENTITY.finditer(text)]


_ENTITIES = ArrayType(StructType([StructField("kind", StringType()), StructField("canon", StringType())]))


@F.pandas_udf(_ENTITIES)
def _entities(text: pd.Series) -> pd.Series:
    return pd.Series([[{"kind": k, "canon": c} for k, c in sorted({e[:2] for e in find_entities(t or "")})]
                      for t in text], dtype=object)


def assign_surrogates(entities, key):
    """One surrogate per distinct ``(kind, canon)``, none shared and none equal to an entity.

    Every entity starts with attempt 0; of those that clash the lowest keeps its surrogate and
    the others try again, until nobody clashes.  Returns ``(kind, canon, made, attempt)``.
    """
    @F.pandas_udf(StringType())
    def make(kind: pd.Series, canon: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, k, c, a) for k, c, a in zip(kind, canon, attempt)], dtype=object)

    known = materialize(entities.select("kind", "canon").distinct())
    made = materialize(known.withColumn("attempt", F.lit(0)).withColumn(
        "made", make("kind", "canon", "attempt")))
    while True:
        first = made.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        real = known.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real"))
        marked = materialize(
            made.join(first, ["kind", "made"]).join(real, ["kind", "made"], "left")
            .withColumn("again", F.coalesce("real", F.lit(False))
                        | (F.struct("attempt", "canon") != F.col("first"))).drop("first", "real"))
        if marked.where("again").isEmpty():
            return marked.select("kind", "canon", "made", "attempt")
        made = materialize(
            marked.where("NOT again").select("kind", "canon", "attempt", "made").union(
                marked.where("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
                .withColumn("made", make("kind", "canon", "attempt"))))


def replace_personal_data(docs, key="corpus", id_col="doc_id", text_col="text"):
    """All columns of ``docs`` with surrogates in the text, and ``n_entities``.

    E-mail addresses, secrets, IP addresses, IBANs, phone, card and security numbers, and
    names after a form of address.  One entity gets one surrogate everywhere, written as each
    mention is; two entities never get the same one.  Null texts stay null with 0 entities,
    empty texts stay empty, repeated rows are treated alike, ``n_entities`` of the input is
    replaced.

    Surrogates follow from the key, so a text is replaced where it lies.  Only the entities
    whose first surrogate clashed are joined to their documents.
    """
    small_batches(docs.sparkSession)
    found = docs.select(F.explode(_entities(F.col(text_col))).alias("e")).select("e.*")
    late = materialize(assign_surrogates(found, key).where("attempt > 0"))
    base = docs
    if late.isEmpty():
        base = docs.withColumn("__late", F.lit(None).cast("map<string,string>"))
    else:
        mine = docs.select(F.col(id_col), F.explode(_entities(F.col(text_col))).alias("e")).select(
            id_col, "e.kind", "e.canon").join(late, ["kind", "canon"])
        mine = mine.select(id_col, F.concat_ws("\0", "kind", "canon").alias("k"), "made").distinct()
        maps = materialize(mine.groupBy(id_col).agg(
            F.map_from_entries(F.collect_list(F.struct("k", "made"))).alias("__late")))
        maps = maps.withColumnRenamed(id_col, "__id")
        base = docs.join(maps, docs[id_col].eqNullSafe(maps["__id"]), "left")

    out = StructType([StructField("text", StringType()), StructField("kinds", ArrayType(StringType()))])

    @F.pandas_udf(out)
    def rewrite(text: pd.Series, late_of: pd.Series) -> pd.DataFrame:
        memory, rows = {}, []
        for t, fixed in zip(text, late_of):
            entities = find_entities(t or "")
            parts, at = [], 0
            fixed = dict(fixed) if fixed is not None else {}
            for kind, canon, a, b in entities:
                made = fixed.get(f"{kind}\0{canon}")
                if made is None:
                    made = memory.get((kind, canon))
                    if made is None:
                        made = memory[kind, canon] = surrogate(key, kind, canon)
                parts += [t[at:a], render(kind, made, t[a:b])]
                at = b
            rows.append((t if t is None or not entities else "".join(parts) + t[at:],
                         [e[0] for e in entities]))
        return pd.DataFrame(rows, columns=["text", "kinds"])

    done = base.withColumn("__new", rewrite(F.col(text_col), F.col("__late")))
    columns = [F.col("__new.text").alias(c) if c == text_col else F.col(c)
               for c in docs.columns if c not in ("n_entities",)]
    return done.select(*columns, F.size("__new.kinds").cast("long").alias("n_entities"))
