"""Private data replaced by keyed surrogates of the same type and format."""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import string
import unicodedata
from collections import Counter
from typing import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, fresh, written

#: The key where a session names none in KEY_SETTING. It is known to all who read this: set another to keep short numbers secret.
KEY, KEY_SETTING = b"surrogates", "spark.tidewright.pii.key"
#: Draws after which what is drawn grows with each draw.
SHORT_DRAWS = 4

#: Given names by script and gender, and family names by script.
GIVEN = {
    ("latin", "f"): ["Alice", "Clara", "Diana", "Elena", "Fiona", "Greta", "Helen", "Irene", "Julia", "Karen", "Laura", "Maria", "Nadia", "Olivia", "Paula", "Rosa", "Sarah", "Teresa", "Vera", "Wanda"],
    ("latin", "m"): ["Adam", "Boris", "Carlos", "David", "Erik", "Felix", "George", "Hugo", "Ivan", "James", "Karl", "Louis", "Martin", "Noah", "Oscar", "Peter", "Robert", "Simon", "Thomas", "Victor"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Татьяна"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Денис", "Иван", "Максим", "Николай", "Олег", "Павел", "Сергей"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"],
    ("greek", "m"): ["Αλέξης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
}
FAMILY = {
    "latin": ["Abbott", "Barnes", "Carter", "Dalton", "Ellis", "Fisher", "Graham", "Harris", "Ingram", "Jensen", "Keller", "Larsen", "Meyer", "Norton", "Owens", "Parker", "Quinn", "Reyes", "Sanders", "Turner", "Vogel", "Walker", "Young", "Zimmer"],
    "cyrillic": ["Беляев", "Волков", "Громов", "Егоров", "Жуков", "Зайцев", "Козлов", "Лебедев", "Морозов", "Новиков"],
    "greek": ["Ανδρέου", "Βασιλείου", "Γεωργίου", "Δημητρίου", "Κωνσταντίνου", "Νικολάου"],
}
#: Letters of the syllables that lengthen a name when the lists are used up.
SYLLABLES = {"latin": ("bdfgklmnprst", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειου")}
#: Titles that come before a name, with the gender that they tell.
TITLES = {"Mr.": "m", "Mrs.": "f", "Ms.": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Dr.": "", "Prof.": ""}

_TITLES = "|".join(re.escape(t) for t in sorted({*TITLES, *map(str.upper, TITLES)}, key=len, reverse=True))
_EMAIL = r"[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"
_AWS = r"A(?:KIA|SIA)[A-Z0-9]{16}\b"
#: A word of a name, which may be joined by apostrophes and hyphens; a possessive s stays outside.
_NAME = r"[^\W\d_a-z](?:[^\W\d_]|-(?=[^\W\d_])|['’](?![sS]\b)(?=[^\W\d_]))+"
#: Small words inside family names, and what follows a doctor's title.
PARTICLES = "de van von der den da di del della la le du dos ter zu af y".split()
_AFTER = r"(?:[ \t]+(?:med|phil|rer|nat|jur|ing|h\. ?c)\.)*"
#: Between a title and what follows: spaces, or one line's end.
_GAP = r"(?:[ \t]+(?:\n[ \t]*)?|\n[ \t]*)"
#: One part of a name: initials and particles before a word.
_PART = rf"(?:[^\W\d_a-z]\.[ \t]?){{0,3}}(?:(?:{'|'.join(PARTICLES)})[ \t]+){{0,3}}{_NAME}"
#: Between a secret's keyword and its value: = or :, spaces and quotes. What is an address or a key of its own kind stays one.
_IS = rf"[\"']?[ \t]*[=:][ \t]*[\"']?(?!{_EMAIL}|{_AWS})"

#: First alternatives win. Names need a title, a full name follows; secrets need a keyword, in any case; other kinds tell
#: themselves by their form. The entity is the named group.
PATTERN = re.compile(
    rf"(?P<email>(?<![\w.+%-]){_EMAIL})"
    rf"|(?P<aws>\b{_AWS})"
    rf"|(?:(?i:passw(?:or)?d){_IS}(?=[^\s\"']{{6}})|(?i:token|api[_ -]?key|secret){_IS}(?=[^\s\"']{{8}}))(?P<secret>[^\s\"']+)"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<card>(?<![\d.-])(?:\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|3[47]\d{2}(?P<wide>[ -]?)\d{6}(?P=wide)\d{5})(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-]))"
    r"|(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:]))"
    rf"|(?:(?i:Señora?){_GAP}(?P<spanish>{_PART}(?:[ \t]{{1,2}}{_PART}){{0,3}})|(?:(?:{_TITLES}){_AFTER}{_GAP})+(?P<name>{_PART}(?:[ \t]{{1,2}}{_PART})?))"
)
#: A text without any of these holds no entity.
HINT = re.compile(rf"[@\d]|(?i:passw|token|api[_ -]?key|secret)|(?:{_TITLES})\s|(?i:med|phil|jur)\.\s")


def script_of(text: str) -> str:
    name = unicodedata.name(next((c for c in text if c.isalpha()), "a"), "LATIN")
    return next((s for s in ("cyrillic", "greek") if name.startswith(s.upper())), "latin")


def gender_of(text: str, start: int, name: str) -> str:
    """From the title before the name, else from a known given name, else unknown ('')."""
    told = ""
    for title in reversed(text[max(0, start - 40) : start].split()):  # of titles in a row any may tell
        known = TITLES.get(title, TITLES.get(title.capitalize()))
        if known is None and not re.fullmatch(r"(?i:med|phil|rer|nat|jur|ing|h|c)\.(?:c\.)?", title):
            break
        told = told or known or ""
    given = name.split()[0].title()
    return told or next((g for (_, g), names in GIVEN.items() if given in names), "")


def canonical(kind: str, found: str, text: str, start: int) -> str:
    """What mentions of one entity share: e-mail addresses in lower case, digits of numbers, a name with script and gender."""
    if kind == "email":
        return found.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", found)
    if kind == "phone":
        digits = re.sub(r"\D", "", found)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "name":
        return f"{script_of(found)}:{gender_of(text, start, found)}:{' '.join(found.split())}"
    return found.lower() if kind == "ipv6" else found


class _Stream:
    """Numbers drawn from HMAC-SHA256 of key, kind, round and value."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.seed, self.block, self.left = f"{kind}\x00{attempt}\x00{value}".encode(), 0, b""
        self.key = key

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hmac.new(self.key, self.seed + self.block.to_bytes(4, "little"), hashlib.sha256).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "little"), self.left[4:]
        return x % n


def _is_hexadecimal(value: str) -> bool:
    """Whether a secret is a hexadecimal number: long, with digits and letters a to f."""
    return re.fullmatch(r"(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}", value) is not None


def _redrawn(value: str, draw: _Stream, hexadecimal: bool = False) -> str:
    """Every letter and digit anew, of the same kind and case; other characters stay. A hexadecimal number's digits and letters
    are of one kind."""
    out = []
    for c in value:
        if hexadecimal and c in "0123456789abcdef":
            out.append("0123456789abcdef"[draw.below(16)])
        elif c.isascii() and c.isdigit():
            out.append(string.digits[draw.below(10)])
        elif c.isascii() and c.isalpha():
            out.append((string.ascii_lowercase if c.islower() else string.ascii_uppercase)[draw.below(26)])
        elif script_of(c) == "cyrillic" and c.isalpha():
            out.append(chr((0x430 if c.islower() else 0x410) + draw.below(32)))
        elif script_of(c) == "greek" and c.isalpha():
            out.append(chr((0x3B1 if c.islower() else 0x391) + draw.below(17)))
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _mod97(x: str) -> int:
    return int("".join(str(int(c, 36)) for c in x)) % 97


def surrogate(kind: str, value: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The replacement of an entity's canonical value, itself canonical."""
    draw = _Stream(key, kind, value, attempt)
    more = max(0, attempt - SHORT_DRAWS + 1)  # so many letters or syllables are added: no space of draws is ever used up
    if kind == "email":
        local, _, domain = value.partition("@")
        *labels, last = domain.split(".")
        return f"{_redrawn(local, draw)}{''.join(string.ascii_lowercase[draw.below(26)] for _ in range(more))}@{'.'.join(_redrawn(x, draw) for x in labels)}.{last}"
    if kind == "aws":
        return value[:4] + "".join((string.ascii_uppercase + string.digits)[draw.below(36)] for _ in value[4:])
    if kind == "ip" and more:  # any octets, of other lengths too
        return ".".join(str(1 + draw.below(254)) for _ in range(4))
    if kind == "ip":
        return ".".join(str((1 + draw.below(9), 10 + draw.below(90), 100 + draw.below(124))[len(x) - 1]) for x in value.split("."))
    if kind == "iban":
        rest = _redrawn(value[4:], draw)
        if _mod97(value[4:] + value[:4]) == 1:  # stays valid
            return f"{value[:2]}{98 - _mod97(f'{rest}{value[:2]}00'):02}{rest}"
        return value[:2] + _redrawn(value[2:4], draw) + rest
    if kind == "card":
        digits = value[0] + "".join(str(draw.below(10)) for _ in value[1:])
        if _luhn(value) == 0:  # stays valid
            digits = next(d for d in (digits[:-1] + str(x) for x in range(10)) if _luhn(d) == 0)
        return digits
    if kind == "name":
        script, gender, name = value.split(":", 2)
        gender = gender or "fm"[draw.below(2)]
        names, families = GIVEN[script, gender], FAMILY[script]
        words = name.split()
        # beyond the lists' product syllables are added, one more with each draw, so that every name can have its own
        heads, vowels = SYLLABLES[script]
        extra = "".join(heads[draw.below(len(heads))] + vowels[draw.below(len(vowels))] for _ in range(more))
        if len(words) == 1:
            new = families[draw.below(len(families))] + extra + ("" if attempt < 2 else f"-{families[draw.below(len(families))]}")
        else:
            # word by word: initials and particles as they are, the last word a family's, those before given names
            last = max(i for i, w in enumerate(words) if not w.endswith(".") and w not in PARTICLES)
            given = lambda: names[draw.below(len(names))]
            drawn = [given() if i != last else families[draw.below(len(families))] + extra for i in range(len(words))]
            new = " ".join(w if w in PARTICLES else "".join(f"{given()[0]}." for _ in range(w.count("."))) if w.endswith(".") else d for w, d in zip(words, drawn))
        return f"{script}:{value.split(':', 2)[1]}:{new.upper() if name.isupper() else new}"
    if kind == "phone":
        # a country's code stays
        return "".join(c if i < len(value) - 10 or i == len(value) - 10 and c == "1" else str(2 + draw.below(8)) if i in (len(value) - 10, len(value) - 7) else str(draw.below(10)) for i, c in enumerate(value))
    if kind == "ipv6":
        return _redrawn(value, draw, hexadecimal=True)
    new = _redrawn(value, draw, kind == "secret" and _is_hexadecimal(value))
    # a longer one where these are used up, of the last character's kind
    return new if kind == "ssn" else new + "".join(string.digits[draw.below(10)] if value[-1].isdigit() else "abcdef"[draw.below(6)] for _ in range(more))


def shown(kind: str, new: str) -> str:
    """A canonical surrogate as texts have it: a name without its script and gender."""
    return new.split(":", 2)[2] if kind == "name" else new


def rendered(kind: str, found: str, new: str, whole: bool = False) -> str:
    """A canonical surrogate in the format of a mention: its separators, prefix and case. whole: a family name told alone
    gets the whole name, where another person's surrogate in the text has the same family name."""
    if kind in ("card", "ssn", "phone", "iban"):
        places = [i for i, c in enumerate(found) if c.isalnum()]
        out = list(found)
        for i, c in zip(places[len(places) - len(new) :], new):
            out[i] = c
        return "".join(out)
    if kind == "email" and found != found.lower():
        return "".join(b.upper() if a.isupper() else b for a, b in zip(found, new)) if len(found) == len(new) else new
    if kind == "ipv6":
        return new.upper() if found.isupper() else new
    if kind == "name":
        name = shown(kind, new)
        if _family(found) == " ".join(found.split()) and not whole:  # told alone, perhaps with its particles
            name = " ".join([w for w in found.split() if w in PARTICLES] + [name.rpartition(" ")[2]])
        return name.upper() if found.isupper() else name
    return shown(kind, new)


def _family(name: str) -> str:
    """The last word of a name, with the particles before it."""
    words = name.split()
    at = len(words) - 1
    while at and words[at - 1] in PARTICLES:
        at -= 1
    return " ".join(words[at:])


def mentions(text: str | None) -> list[tuple[str, str, str, int, int]]:
    """kind, mention, canonical value, start, end of every entity, in order.

    Where titles tell a full name, it is one entity at all its mentions in the text, with a title or without and in any case, and so
    is its family name after a title, if the text has no other full name with that, or none other of the title's gender.
    """
    if not text or not HINT.search(text):
        return []
    kind_of = lambda m: "name" if m.lastgroup == "spanish" else m.lastgroup
    found = [(kind_of(m), m[m.lastgroup], canonical(kind_of(m), m[m.lastgroup], text, m.start(m.lastgroup)), m.start(m.lastgroup), m.end(m.lastgroup)) for m in PATTERN.finditer(text)]
    plain = lambda mention: " ".join(mention.split()).casefold()
    full: dict[str, str] = {}
    for kind, mention, value, _, _ in found:
        if kind == "name" and _family(mention) != " ".join(mention.split()):
            full.setdefault(plain(mention), value)
    if not full:
        return found
    families: dict[str, dict[str, str]] = {}
    for value in full.values():
        families.setdefault(plain(_family(value.split(":", 2)[2])), {}).setdefault(value, value.split(":", 2)[1])

    def named(mention: str, value: str) -> str:
        """The full name that a mention means: the only one with its family name, or the only one of its title's gender."""
        if plain(mention) in full:
            return full[plain(mention)]
        known, gender = families.get(plain(mention), {}), value.split(":", 2)[1]
        fit = [v for v, g in known.items() if not gender or not g or g == gender] if len(known) > 1 else list(known)
        return fit[0] if len(fit) == 1 else value

    found = [(k, m, named(m, v) if k == "name" else v, a, b) for k, m, v, a, b in found]
    bare = re.compile(r"(?<![\w'’-])(?:" + "|".join(r"[ \t]{1,2}".join(map(re.escape, n.split())) for n in sorted(full, key=len, reverse=True)) + r")(?![\w-])", re.IGNORECASE)
    ends, more = [b for *_, b in found], []
    for m in bare.finditer(text):
        at = bisect.bisect_right(ends, m.start())  # the first entity that ends after its beginning
        if at == len(found) or found[at][3] >= m.end():
            more.append(("name", m[0], full[plain(m[0])], m.start(), m.end()))
    return sorted(found + more, key=lambda x: x[3])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's entities, once a document."""
    for batch in batches:
        rows = sorted({(d, k, v) for d, t in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()) for k, _, v, _, _ in mentions(t)}, key=str)
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "kind", "value"])


def _drawn(key: bytes):
    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [surrogate(k, v, a, key) for k, v, a in zip(*(batch[c].to_pylist() for c in ("kind", "value", "attempt")))]
            as_shown = [shown(k, x) for k, x in zip(batch["kind"].to_pylist(), new)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string()), pa.array(as_shown, pa.string())], names=[*batch.schema.names, "surrogate", "shown"])

    return drawn


def assigned(entities: DataFrame, key: bytes = KEY) -> tuple[DataFrame, int]:
    """(kind, value, attempt, surrogate) of distinct entities(kind, value), no two of a kind alike in texts and none that is
    itself an entity; and how many needed a later draw.

    Each round draws for the open ones and keeps those whose draw isn't an entity, hasn't been given, and is the draw of
    no smaller open value, all as texts show them. The few others draw again, from a larger space each time, until none is open.
    """
    entities = cut(entities)
    todo, done, attempt = entities.withColumn("attempt", F.lit(0)), None, 0
    plain = F.when(F.col("kind") == "name", F.regexp_replace("value", "^[^:]*:[^:]*:", "")).otherwise(F.col("value"))
    taken = entities.select("kind", plain.alias("shown"))
    while True:
        drawn = cut(todo.mapInArrow(_drawn(key), "kind string, value string, attempt int, surrogate string, shown string"))
        first = drawn.groupBy("kind", "shown").agg(F.min("value").alias("value"))
        free = cut(drawn.join(first, ["kind", "shown", "value"]).join(taken, ["kind", "shown"], "left_anti").select("kind", "value", "attempt", "surrogate", "shown"))
        done = free if done is None else done.unionByName(free)
        todo = cut(drawn.join(free, ["kind", "value"], "left_anti").select("kind", "value", (F.col("attempt") + 1).alias("attempt")))
        if todo.isEmpty():
            break
        taken, attempt = taken.unionByName(free.select("kind", "shown")), attempt + 1
    done = done.drop("shown")
    later = done.where("attempt > 0").count() if attempt else 0
    return done, later


def replace_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """docs with text's entities replaced, n_entities (mentions replaced) and kinds (of them, sorted, joined by commas).

    A surrogate is drawn with the key from the entity's canonical value: an entity has the same one in all documents and
    formats, and different entities have different ones (see assigned()). Draws are made again from the value where
    texts are rewritten, so only the entities that needed a later draw are joined to their documents: by broadcast where
    Spark finds that table small, else by shuffle. Null and empty texts stay. Rows repeated under one doc_id share their
    later draws. Columns of docs named n_entities or kinds are replaced. Without a key the session's setting KEY_SETTING holds.
    """
    key = docs.sparkSession.conf.get(KEY_SETTING, KEY.decode()).encode() if key is None else key
    doc_name, later_name = fresh("__doc", docs), fresh("__later", docs)
    carried = [c for c in docs.columns if c not in ("n_entities", "kinds")]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    seen = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_found, "doc_id long, kind string, value string"))
    done, later = assigned(seen.select("kind", "value").distinct(), key)
    base = docs.select(*carried)
    if later:
        drawn = done.where("attempt > 0").select("kind", "value", "attempt")
        by_doc = seen.join(drawn, ["kind", "value"]).groupBy(F.col("doc_id").alias(doc_name)).agg(F.collect_set(F.struct("kind", "value", "attempt")).alias(later_name))
        base = base.join(written(by_doc), F.col("doc_id").cast("long").eqNullSafe(F.col(doc_name)), "left").drop(doc_name)
    else:
        base = base.withColumn(later_name, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>"))

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, str] = {}
        for batch in batches:
            texts, counts, told = [], [], []
            for text, later in zip(batch["text"].to_pylist(), batch[later_name].to_pylist()):
                again = {(x["kind"], x["value"]): x["attempt"] for x in later or ()}
                out, at, n, had = [], 0, 0, set()
                here = mentions(text)
                for kind, _, value, _, _ in here:
                    this = (kind, value, again.get((kind, value), 0))
                    if this not in known:
                        if len(known) > 100_000:
                            known.clear()
                        known[this] = surrogate(*this, key)
                new_of = {(k, v): known.get((k, v, again.get((k, v), 0))) or surrogate(k, v, again.get((k, v), 0), key) for k, _, v, _, _ in here}
                last_names = Counter(shown(k, x).rpartition(" ")[2] for (k, _), x in new_of.items() if k == "name")
                for kind, found, value, start, end in here:
                    new = new_of[kind, value]
                    whole = kind == "name" and last_names[shown(kind, new).rpartition(" ")[2]] > 1
                    out += [text[at:start], rendered(kind, found, new, whole)]
                    at, n = end, n + 1
                    had.add(kind)
                texts.append("".join([*out, text[at:]]) if n else text)
                counts.append(n)
                told.append(",".join(sorted(had)))
            new = {"text": pa.array(texts, pa.string()), "n_entities": pa.array(counts, pa.int64()), "kinds": pa.array(told, pa.string())}
            names = [*carried, "n_entities", "kinds"]
            yield pa.RecordBatch.from_arrays([new[c] if c in new else batch[c] for c in names], names=names)

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carried), "n_entities long, kinds string"])
    return base.mapInArrow(rewritten, schema)
