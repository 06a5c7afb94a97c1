"""Variant spellings of names that refer to one person or company.

A name is parsed into given names, surnames and initials, or into a company's own words and its line of business.
Rows with a usable identifier form a cluster for each identifier, named by all of its forms; rows without
one collapse by parsed name and mask. Names are sharded by pairs of their words (and of word ends, for two typing
errors); in each shard tries of the names' words are traversed with a Levenshtein automaton, and the names
whose words are alike in any order, or alike when joined, are checked over the orders of their words. Clusters are joined when
names agree and identifiers are one typing error apart; a name without identifier joins the one cluster that it fits
best, none when two clusters fit alike (persons of the same name), and otherwise its own kind.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acervo.llm.automata import LONGEST, Forest, letters
from acervo.operators.graph import connected_components
from acervo.session import cut

# Words of company names and persons' names that carry a meaning of their own.
LEGAL = set("ltda limitada sa eireli epp me mei cia companhia sociedade anonima".split())
BUSINESS = """comercio alimentos tecnologia informacao transportes rodoviarios servicos hospitalares participacoes agropecuaria distribuidora bebidas
engenharia construcoes construtora industria metalurgica confeccoes empreendimentos imobiliarios consultoria empresarial administradora importacao
exportacao logistica investimentos incorporadora representacoes materiais sistemas educacional seguros corretora""".split()
JOINTS = set("de da do dos das e d del di du la".split())
TITLES = set("sr sra srta dr dra exmo exma ilmo ilma prof profa espolio".split())
GIVEN = set("""maria mariana ana antonio fernando claudia sandra lucas veronica marcos gustavo patricia daniel raimundo bruno gabriela camila felipe
carlos luiz luis roberto ricardo juliana pedro benedita leticia conceicao sebastiao estevao iris heitor sonia monica francisco vera sergio beatriz aline
paulo joao rosangela otavio eduardo rafael adriana marcia fabio jose teresa regina cristina andre alexandre rodrigo marcelo julio vinicius thiago diego
fernanda amanda bruna larissa renata simone tatiana vanessa helena isabel lucia rita rosa raquel sara silvia marina manoel manuel joaquim jorge geraldo
mario nelson oscar henrique guilherme leonardo matheus miguel arthur davi gabriel laura julia alice sofia cecilia elisa clara diana denise edson""".split())
GIVEN_IN_ORDER = sorted(GIVEN)
NICKNAMES = {
    "ze": "jose", "zezinho": "jose", "chico": "francisco", "toninho": "antonio", "tonho": "antonio", "beto": "roberto", "rico": "ricardo", "cadu": "carlos",
    "dudu": "eduardo", "edu": "eduardo", "guga": "gustavo", "gu": "gustavo", "mila": "camila", "lu": "lucia", "luizinho": "luiz", "joaozinho": "joao", "nando": "fernando", "nanda": "fernanda",
    "fe": "felipe", "lipe": "felipe", "rafa": "rafael", "gabi": "gabriela", "biel": "gabriel", "bia": "beatriz", "ju": "juliana", "pati": "patricia", "paty": "patricia",
    "dani": "daniel", "le": "leticia", "lele": "leticia", "mari": "mariana", "mariazinha": "maria", "aninha": "ana", "cida": "aparecida", "tiao": "sebastiao", "serginho": "sergio",
    "paulinho": "paulo", "pedrinho": "pedro", "marquinhos": "marcos", "carlinhos": "carlos", "fabinho": "fabio", "bruninho": "bruno", "luquinhas": "lucas", "tata": "otavio",
    "dri": "adriana", "dea": "andrea", "nica": "monica", "vero": "veronica", "ro": "rosangela", "rosinha": "rosa", "verinha": "vera", "claudinha": "claudia", "sandrinha": "sandra",
    "marcinha": "marcia", "raimundinho": "raimundo", "dinha": "benedita", "dita": "benedita", "manu": "manuel", "tete": "teresa", "mundico": "raimundo", "teca": "teresa", "soninha": "sonia",
}
_TITLE = re.compile(rf"^[\W_]*(?:(?:{'|'.join(sorted(TITLES))})\b\.?\W*(?:de\s+)?)+")
_TOKEN = re.compile(r"[a-z0-9]+\.?")


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance, most + 1 where it is larger (bit-parallel: a column of the table is one integer)."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, diagonal, last, score = full, 0, 0, 0, len(a)
    for c in b:
        here = places.get(c, 0)
        swapped = (~diagonal & here) << 1 & last
        diagonal = (((here & up) + up) ^ up | here | down | swapped) & full
        more, less = (down | ~(diagonal | up)) & full, diagonal & up
        if more & top:
            score += 1
        elif less & top:
            score -= 1
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down, last = (less | ~(diagonal | more)) & full, more & diagonal, here
    return min(score, most + 1)


def sounded(word: str) -> str:
    """One spelling of letters that are typed for each other by ear: k and qu, w and v, y and i, ph and f, doubled and single."""
    word = re.sub(r"k(?=[ei])", "qu", word).replace("k", "c").replace("w", "v").replace("y", "i").replace("ph", "f")
    return re.sub(r"(.)\1+", r"\1", word)


def slack(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def alike(a: str, b: str) -> bool:
    return a == b or distance(a, b, min(slack(a), slack(b))) <= min(slack(a), slack(b))


class Trie:
    """Names by letters; near() runs a Levenshtein automaton (one row of the alignment table a node) down the tree."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, value: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node.setdefault("", []).append(value)

    def near(self, word: str, most: int) -> set[int]:
        found: set[int] = set()
        start = list(range(len(word) + 1))
        stack = [(self.root, start, None, "")]
        while stack:
            node, row, above, last = stack.pop()
            if row[-1] <= most and "" in node:
                found.update(node[""])
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j, x in enumerate(word, 1):
                    d = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (x != c))
                    if above is not None and j > 1 and x == last and word[j - 2] == c:
                        d = min(d, above[j - 2] + 1)
                    new.append(d)
                if min(new) <= most or above is not None and min(row) <= most:
                    stack.append((child, new, row, c))
        return found


@dataclass(frozen=True)
class Name:
    """A parsed name. Persons have given, initials and words (surnames); companies have words (their own) and business."""

    kind: str
    given: str = ""
    more: tuple[str, ...] = ()
    initials: tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    business: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return "|".join([self.kind, self.given, " ".join(self.more), " ".join(self.initials), " ".join(self.words), " ".join(self.business)])

    @classmethod
    def of_key(cls, key: str) -> Name:
        kind, given, more, initials, words, business = key.split("|")
        return cls(kind, given, tuple(more.split()), tuple(initials.split()), tuple(words.split()), tuple(business.split()))

    @property
    def completeness(self) -> int:
        return 10 * (len(self.given) > 1) + 10 * len(self.words) + 3 * len(self.more) - 2 * len(self.initials) + len(self.business)


class Memo(dict):
    """Results of a function by its arguments, kept for a bounded number of them."""

    def __init__(self, function) -> None:
        super().__init__()
        self.function = function

    def __missing__(self, key: tuple):
        if len(self) > 200_000:
            self.clear()
        self[key] = found = self.function(*key)
        return found

    def __reduce__(self):
        return (Memo, (self.function,))


def business_word(token: str, abbreviated: bool) -> tuple[str, ...]:
    """The line-of-business words that a token stands for: itself, with a typing error, or shortened."""
    if token == "ti":
        return ("tecnologia", "informacao")
    if token in BUSINESS:
        return (token,)
    if len(token) >= 3 and (abbreviated or len(token) >= 5):
        shortened = [w for w in BUSINESS if w.startswith(token)]
        if shortened:
            return (shortened[0],)
    if len(token) >= 6:
        for w in BUSINESS:
            if len(w) >= 6 and w in token and len(token) <= len(w) + 3:
                return (w,)
        for w in BUSINESS:
            if distance(token, w, 2 if len(w) > 8 else 1) <= (2 if len(w) > 8 else 1):
                return (w,)
    return ()


def _given_name(token: str, most: int) -> str:
    """The formal given name that a token is, with `most` typing errors, or ''."""
    if token in NICKNAMES:
        return NICKNAMES[token]
    if token in GIVEN:
        return token
    if len(token) >= 4:
        for g in GIVEN_IN_ORDER:
            if g[0] == token[0] and len(g) >= 5 and distance(token, g, most) <= most and (most == 1 or len(g) >= 6):
                return g
    return ""


_BUSINESS_WORDS, _GIVEN_NAMES = Memo(business_word), Memo(_given_name)


def given_name(token: str, most: int = 1) -> str:
    return _GIVEN_NAMES[token, most]


def parse(name: str) -> Name:
    text = re.sub(r"[’'`´]", "", folded(name)).replace("&", " e ")
    text = _TITLE.sub("", text)
    before, comma, after = text.partition(",")
    if comma and _TOKEN.search(before) and _TOKEN.search(after) and not set(re.findall(r"[a-z]+", after)) <= LEGAL:
        text = f"{after} {before}"
    text = re.sub(r"\bs ?[./] ?a\b\.?|\bs a$", " sa ", text)
    marked = [(t.rstrip("."), t.endswith(".")) for t in _TOKEN.findall(text)]
    tokens = [(t, dot) for t, dot in marked if t not in JOINTS or dot and len(t) == 1]
    legal = [t for t, _ in tokens if t in LEGAL]
    rest = [(t, dot) for t, dot in tokens if t not in LEGAL]
    business = {t: _BUSINESS_WORDS[t, dot or bool(legal)] for t, dot in rest}
    if legal or any(business.values()):
        own = tuple(sounded(t) for t, _ in rest if not business[t])
        # Beside a longer word of its own a short one is a mistyped joint ("dde", "ade").
        own = tuple(t for t in own if len(t) > 3 or not any(len(x) > 3 for x in own))
        kinds = sorted({w for x in business.values() for w in x})
        return Name("c", words=own, business=tuple(kinds))
    plain = [sounded(t) for t, _ in rest]
    is_given = [len(t) == 1 or bool(given_name(t)) for t in plain]
    if plain and not comma and is_given[-1]:  # surnames first
        whole = [g and len(t) > 1 for g, t in zip(is_given, plain, strict=True)]
        at = whole.index(True) if whole[-1] else is_given.index(True)
        plain = plain[at:] + plain[:at]
    if not plain:
        return Name("p")
    given = given_name(plain[0]) or (given_name(plain[0], 2) if len(plain[0]) >= 6 else "") or plain[0]
    more = tuple(given_name(t) for t in plain[1:] if len(t) > 1 and given_name(t))
    words = tuple(t for t in plain[1:] if len(t) > 1 and not given_name(t))
    return Name("p", given, more, tuple(t for t in plain[1:] if len(t) == 1), words)


def _pairing(a: tuple[str, ...], b: tuple[str, ...], a_initials: list[str], b_initials: list[str]) -> int | None:
    """0 if the words are equal in some order, 1 with typing errors, 2 if initials stand for some; None if a word has no partner.

    Orders are searched along alike words only, so there is no limit to the number of words.
    """
    if len(a) > len(b):
        a, b, a_initials, b_initials = b, a, b_initials, a_initials
    partners = [sorted((j for j, y in enumerate(b) if alike(x, y)), key=lambda j, x=x: x != b[j]) for x in a]
    turns = sorted(range(len(a)), key=lambda i: len(partners[i]))
    best: int | None = None

    def place(step: int, taken: frozenset, typed: bool) -> None:
        nonlocal best
        floor = 2 if len(b) > len(a) else int(typed)
        if best is not None and best <= floor:
            return
        if step < len(a):
            for j in partners[turns[step]]:
                if j not in taken:
                    place(step + 1, taken | {j}, typed or a[turns[step]] != b[j])
            return
        free = list(a_initials)
        for j in range(len(b)):
            if j not in taken:
                if b[j][0] not in free:
                    return
                free.remove(b[j][0])
        best = floor

    place(0, frozenset(), False)
    return best


def agreement(p: Name, q: Name) -> int | None:
    """How well two names agree: 0 the same, 1 typing errors or short forms, 2 initials or left-out parts; None if they do not."""
    if p.kind != q.kind or not p.words or not q.words:
        return None
    if p.kind == "c":
        level = _pairing(p.words, q.words, [], []) if len(p.words) == len(q.words) else None
        if level is None and distance("".join(p.words), "".join(q.words), 2) <= min(2, len("".join(p.words)) // 5):
            level = 1
        if level is None:
            return None
        if p.business and q.business:
            return level if set(p.business) & set(q.business) else None
        return 2
    if p.given == q.given:
        first = 0
    elif len(p.given) == 1 or len(q.given) == 1:
        if p.given[0] != q.given[0]:
            return None
        first = 2
    elif alike(p.given, q.given) and not (p.given in GIVEN and q.given in GIVEN):
        first = 1
    else:
        return None
    if p.more and q.more and not any(alike(x, y) for x in p.more for y in q.more):
        return None
    level = _pairing(p.words, q.words, list(p.initials), list(q.initials))
    if level is None and not p.initials and not q.initials and distance("".join(p.words), "".join(q.words), 2) <= 1:
        level = 1
    if level is None:
        return None
    for x, y in ((p, q), (q, p)):
        letters = [m[0] for m in y.more] + [w[0] for w in y.words]
        if y.more and any(i not in letters for i in x.initials):
            return None
    return max(first, level, 2 if bool(p.more) != bool(q.more) or p.initials != q.initials else 0)


def shard_keys(n: Name) -> set[str]:
    """Places where variants of a name meet: pairs of whole words, of a word with an end of another, of an initial with an end of a surname; ends of companies' words."""
    words = n.words
    if n.kind == "p":
        full = [*([n.given] if len(n.given) > 1 else []), *words]
        keys = {"p " + " ".join(sorted(x)) for x in combinations(full, 2)}
        for a, b in permutations(words, 2):
            keys |= {f"p {a} {b[:3]}^", f"p {a} {b[-3:]}$"}
        # Also for one surname, a lone initial, or an error in either word.
        for w in words:
            keys |= {f"p {n.given[:1]} {w[:3]}^", f"p {n.given[:1]} {w[-3:]}$"}
            if len(n.given) > 1:
                keys |= {f"p {w} {n.given[:3]}^", f"p {w} {n.given[-3:]}$"}
        if len(words) >= 2:
            keys |= {f"p {n.given[:1]} " + " ".join(sorted(w[:3] for w in words)), f"p {n.given[:1]} " + " ".join(sorted(w[-3:] for w in words)) + "$"}
        return keys
    keys = {"c " + " ".join(sorted(x)) for x in combinations(words, 2)}
    for w in words:
        keys |= {f"c {w[:4]}^", f"c {w[-4:]}$"}  # one may leave out its business
        for h in n.business or ("",):
            keys |= {f"c {w} {h}", f"c {w[:4]}^ {h}", f"c {w[-4:]}$ {h}"}
    return keys


def identifier(raw: str | None) -> tuple[str, str]:
    """(identifier, mask) of a raw text: upper-case letters and digits of a whole one, or the visible part of a masked one; both '' for fillers."""
    if not raw:
        return "", ""
    text = re.sub(r"^\W*(CPF|CNPJ)(/MF)?\W*(N[º°O.]*\W+)?", "", unicodedata.normalize("NFC", raw).upper())
    if "*" in text:
        visible = re.sub(r"[^0-9A-Z]", "", text).replace("O", "0")
        return "", visible if len(visible) >= 5 else ""
    core = re.sub(r"[^0-9A-Z]", "", text)
    as_digits = core.translate(str.maketrans("OQILSB", "001158"))
    if as_digits.isdigit():
        core = as_digits
    else:  # letters belong to it; zero and O are one character in all of them
        core = core.replace("O", "0")
    shaped = core.isdigit() and len(core) >= 9 or len(core) >= 13 and core[-4:].isdigit()
    if not shaped or len(core) > 15 or len(set(core)) <= 1 or core in "0123456789012345":
        return "", ""
    return core, ""


def parsed(rows: DataFrame) -> DataFrame:
    """(party_id, name, ident, mask) with the parsed name's key; `rows` has party_id, name, raw_identifier."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [identifier(x) for x in batch.raw_identifier]
            yield pd.DataFrame({"party_id": batch.party_id, "name": [parse(x or "").key for x in batch.name], "ident": [a for a, _ in ids], "mask": [b for _, b in ids]})

    return rows.select("party_id", "name", "raw_identifier").mapInPandas(read, "party_id long, name string, ident string, mask string")


def _runs(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after the other."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


class _Lists:
    """Values grouped by key 0..size-1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, size: int) -> None:
        order = np.argsort(keys, kind="stable")
        self.values = values[order]
        self.counts = np.bincount(keys, minlength=size)
        self.first = np.cumsum(self.counts) - self.counts

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in keys, value), all values of each key."""
        counts = self.counts[keys]
        return np.repeat(np.arange(len(keys)), counts), self.values[np.repeat(self.first[keys], counts) + _runs(counts)]


def _alike_entries(spaces: np.ndarray, texts: list[str], most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, entry) in one space whose texts are within the `most` of both: automata run down the tries of the spaces."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    short = np.flatnonzero(sizes <= LONGEST)
    codes, lengths = letters([texts[i] for i in short])
    forest = Forest(spaces[short], codes, lengths)
    found = [(np.arange(len(texts)), np.arange(len(texts)))]
    for k in np.unique(most[short]).tolist():
        asked = np.flatnonzero(most[short] == k) if k else np.zeros(0, dtype=np.int64)
        for q, w, d in forest.near(spaces[short][asked], codes[asked], lengths[asked], k):
            q, w = short[asked[q]], short[w]
            fits = (d <= most[w]) & (q != w)
            found.append((q[fits], w[fits]))
    tries: dict[int, Trie] = {}  # words beyond what an automaton's table can index
    for i in np.flatnonzero(sizes > LONGEST - 4).tolist():
        tries.setdefault(int(spaces[i]), Trie()).add(texts[i], i)
    for i in np.flatnonzero(sizes > LONGEST).tolist():
        near = np.array([j for j in tries[int(spaces[i])].near(texts[i], int(most[i])) if j != i], dtype=np.int64)
        found += [(np.full(len(near), i), near), (near, np.full(len(near), i))]
    pairs = np.unique(np.stack([np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _meeting(shards: np.ndarray, rows: list[str], open_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of rows (name keys) of one shard that can agree, of which one is open: alike in given name and in each word of the shorter, or in the joined words."""
    count = len(rows)
    parsed_names = {k: Name.of_key(k) for k in set(rows)}
    names = [parsed_names[k] for k in rows]
    person = np.array([n.kind == "p" for n in names], dtype=bool)
    sizes, initials = np.array([len(n.words) for n in names]), np.array([len(n.initials) for n in names])
    # Elements of a row: its words (space 0), its given name (1), its words joined (2).
    flat = [(i, 0, w) for i, n in enumerate(names) for w in n.words] + [(i, 1, n.given) for i, n in enumerate(names) if n.kind == "p"] + [(i, 2, "".join(n.words)) for i, n in enumerate(names)]
    owner, kind = np.array([f[0] for f in flat]), np.array([f[1] for f in flat])
    numbers: dict[tuple, int] = {}
    entry = np.array([numbers.setdefault((s, k, t), len(numbers)) for s, (_, k, t) in zip(shards[owner].tolist(), flat, strict=True)])
    keys = list(numbers)
    spaces, texts, kinds = np.array([3 * s + k for s, k, _ in keys]), [t for *_, t in keys], np.array([k for _, k, _ in keys])
    of_person = np.zeros(len(keys), dtype=bool)
    of_person[entry] = person[owner]
    most = np.array([slack(t) for t in texts])
    lengths = np.array([len(t) for t in texts])
    most = np.where(kinds == 2, np.where(of_person, 1, np.minimum(2, lengths // 5)), most)
    x, y = _alike_entries(spaces, texts, most)
    # An initial stands for each given name that begins with it.
    at = np.flatnonzero(kinds == 1)
    heads = {}
    for i in at.tolist():
        heads.setdefault((spaces[i], texts[i][:1]), ([], []))[len(texts[i]) > 1].append(i)
    both = [(i, j) for lone, full in heads.values() for i in lone for j in full]
    if both:
        both = np.array(both)
        x, y = np.concatenate([x, both[:, 0], both[:, 1]]), np.concatenate([y, both[:, 1], both[:, 0]])
    total = len(keys)
    like, rows_of = _Lists(x, y, total), _Lists(entry, owner, total)
    weight = np.bincount(x, weights=rows_of.counts[y], minlength=total)
    pairs = np.unique(x * total + y)

    def joined_by(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(pairs):
            return np.zeros(len(a), dtype=bool)
        wanted = a * total + b
        return (a >= 0) & (b >= 0) & (pairs[np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)] == wanted)

    def table(k: int, width: int) -> np.ndarray:
        out = np.full((count, width), -1)
        mine = np.flatnonzero(kind == k)
        place = _runs(np.bincount(owner[mine], minlength=count)) if len(mine) else mine
        mine = mine[np.argsort(owner[mine], kind="stable")]
        fits = place < width
        out[owner[mine[fits]], place[fits]] = entry[mine[fits]]
        return out

    words, given, whole = table(0, 5), table(1, 1)[:, 0], table(2, 1)[:, 0]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for joined in (False, True):
        # Each row asks through its element that the fewest rows have alike.
        asked = np.concatenate([whole[:, None] if joined else words, given[:, None]], axis=1)
        cost = np.where(asked >= 0, weight[asked], np.inf)
        rarest = asked[np.arange(count), cost.argmin(axis=1)]
        askers = np.flatnonzero(np.isfinite(cost.min(axis=1)) & (sizes > 0))
        heavy = np.cumsum(weight[rarest[askers]])
        for part in np.split(askers, np.searchsorted(heavy, np.arange(2e6, heavy[-1], 2e6))) if len(askers) else ():
            at, near = like.of(rarest[part])
            back, b = rows_of.of(near)
            a = part[at[back]]
            ok = (a != b) & (open_rows[a] | open_rows[b]) & (sizes[b] > 0) & (person[a] == person[b])
            if joined:
                ok &= (a < b) & ((sizes[a] > 1) | (sizes[b] > 1))
            else:
                more = sizes[b] - sizes[a]
                ok &= np.where(person[a], (more >= 0) & (more <= initials[a]), more == 0) & ((more > 0) | (a < b))
            a, b = a[ok], b[ok]
            ok = ~person[a] | joined_by(given[a], given[b])
            a, b = a[ok], b[ok]
            if joined:
                ok = joined_by(whole[a], whole[b])
                a, b = a[ok], b[ok]
            else:
                for i in range(words.shape[1]):
                    ok = (words[a, i] < 0) | (sizes[b] > words.shape[1])
                    for j in range(words.shape[1]):
                        ok |= joined_by(words[a, i], words[b, j])
                    a, b = a[ok], b[ok]
            out.append((a, b))
    return np.concatenate([a for a, _ in out] or [np.zeros(0, dtype=np.int64)]), np.concatenate([b for _, b in out] or [np.zeros(0, dtype=np.int64)])


def _in_batches(sharded: DataFrame, crowd: int, batch_rows: int, meet, text: str) -> DataFrame:
    """Distinct (x, y), x < y, of `meet` over batches of whole shards. `sharded` has shard, `text` and open; shards without an open row have no meeting.

    A shard above `crowd` rows is dealt into sides and each two sides meet in a part of their own.
    """
    parts = sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("count"), F.max("open").alias("any")).where("count > 1 AND any").withColumn("parts", F.ceil(F.col("count") / crowd))
    parts = cut(parts.select("shard", "count", "parts"))
    sized = sharded.join(parts.select("shard", "parts"), "shard")
    dealt = sized.withColumn("side", F.pmod(F.xxhash64(text), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    placed = dealt.withColumn("part", F.greatest("side", "other") * F.col("parts") + F.least("side", "other"))
    batches = max(1, (parts.agg(F.sum(F.col("count") * F.col("parts")).alias("n")).first().n or 0) // batch_rows)
    batched = placed.select("shard", "part", text, "open", F.pmod(F.xxhash64("shard", "part"), F.lit(batches)).alias("batch"))

    def link(table: pa.Table) -> pa.Table:
        numbers: dict[tuple, int] = {}
        shards = np.array([numbers.setdefault(s, len(numbers)) for s in zip(table.column("shard").to_pylist(), table.column("part").to_pylist(), strict=True)])
        rows = table.column(text).to_pylist()
        a, b = meet(shards, rows, table.column("open").to_numpy())
        found = list({(rows[i], rows[j]) if rows[i] < rows[j] else (rows[j], rows[i]) for i, j in zip(a.tolist(), b.tolist(), strict=True)})
        return pa.table({"x": pa.array([x for x, _ in found], pa.string()), "y": pa.array([y for _, y in found], pa.string())})

    return batched.groupBy("batch").applyInArrow(link, "x string, y string").where("x < y").distinct()


def name_links(names: DataFrame, crowd: int, batch_rows: int = 40_000, verify_rows: int = 20_000) -> DataFrame:
    """(x, y, level), x < y: names that agree, of which one at least is open. `names` has name (distinct) and open.

    The pairs of all shards are made distinct before agreement is decided, so that each is decided once.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, n, o) for n, o in zip(batch.name, batch.open, strict=True) for k in shard_keys(Name.of_key(n))], columns=["shard", "name", "open"])

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            levels = [agreement(Name.of_key(x), Name.of_key(y)) for x, y in zip(batch.x, batch.y, strict=True)]
            yield pd.DataFrame({"x": batch.x, "y": batch.y, "level": pd.array(levels, dtype="Int32")}).dropna()

    met = cut(_in_batches(names.select("name", "open").mapInPandas(spread, "shard string, name string, open boolean"), crowd, batch_rows, _meeting, "name"))
    return met.repartition(max(1, met.count() // verify_rows)).mapInPandas(decide, "x string, y string, level int")


def identifier_links(idents: DataFrame, crowd: int, batch_rows: int = 100_000) -> DataFrame:
    """(x, y), x < y: identifiers one typing error apart. `idents` has ident (distinct).

    One error leaves the first or the last half whole, so identifiers meet by halves; automata run down the tries of each meeting.
    """

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f"{side}{x[:n] if side == '^' else x[-n:]}", x, True) for x in batch.ident for n in {(len(x) - 2) // 2, (len(x) - 1) // 2} for side in "^$"]
            yield pd.DataFrame(rows, columns=["shard", "ident", "open"])

    def meet(shards: np.ndarray, rows: list[str], _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = _alike_entries(shards, [r.lower() for r in rows], np.ones(len(rows), dtype=np.int64))
        return a[a < b], b[a < b]

    return _in_batches(idents.select("ident").mapInPandas(spread, "shard string, ident string, open boolean").distinct(), crowd, batch_rows, meet, "ident")


def entities(rows: DataFrame, crowd: int = 20_000) -> DataFrame:
    """(party_id, entity): the rows of one person or company share their entity. `rows` has party_id, name, raw_identifier.

    Defined results: a null or blank name without a usable identifier is an entity of its own; fillers and masks are no
    identifiers; equal names without identifier are one entity unless two identified ones bear that name; repeated
    rows share their entity; an empty table gives none.
    """
    read = cut(parsed(rows.where("party_id IS NOT NULL")))
    spelled = read.withColumn("node", F.concat_ws("#", F.col("name"), F.col("mask"))).withColumn("blank", F.col("name").rlike(r"^.\|+$"))
    forms = cut(spelled.where("NOT blank").select("node", "name", "ident", "mask").distinct())
    names = forms.groupBy("name").agg(F.max(F.col("ident") == "").alias("open"))
    links = cut(name_links(names, crowd))

    # Identifiers one error apart are one entity where names of both agree.
    held = forms.where("ident <> ''").select("ident", "name").distinct()
    near = identifier_links(held.select("ident").distinct(), crowd)
    named = near.join(held.select(F.col("ident").alias("x"), F.col("name").alias("name_x")), "x").join(held.select(F.col("ident").alias("y"), F.col("name").alias("name_y")), "y")
    kin = cut(named.mapInPandas(_of_agreeing_names, "x string, y string").distinct())
    joined = connected_components(kin, "x", "y").select(F.col("node").alias("ident"), F.col("component").alias("family"))
    housed = held.join(joined, "ident", "left").withColumn("family", F.coalesce("family", "ident"))

    # What agrees with a name without identifier: the families that bear the other name, or of a masked one those of them that hold its visible part.
    both = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"), "level")).unionByName(names.where("open").select(F.col("name").alias("x"), F.col("name").alias("y"), F.lit(0).alias("level")))
    nodes = forms.where("ident = ''").select("node", "name", "mask").distinct()
    asked = nodes.join(both.withColumnRenamed("x", "name"), "name")
    borne = housed.groupBy(F.col("name").alias("y")).agg(F.min("family").alias("first"), F.max("family").alias("last"))
    plain = asked.where("mask = ''").join(borne, "y").select("node", "level", "first", "last")
    masked = asked.where("mask <> ''").select("node", "mask", "y", "level")
    shown = F.expr("array_distinct(flatten(transform(sequence(5, length(ident)), n -> transform(sequence(1, length(ident) - n + 1), i -> substring(ident, i, n)))))")
    parts_of = housed.join(masked.select(F.col("y").alias("name")).distinct(), "name", "left_semi").select(F.col("name").alias("y"), "family", F.explode(shown).alias("mask"))
    veiled = masked.join(parts_of, ["y", "mask"]).select("node", "level", F.col("family").alias("first"), F.col("family").alias("last"))
    fits = plain.unionByName(veiled).groupBy("node", "level").agg(F.min("first").alias("family"), F.max("last").alias("last"))
    # The best level at which a name fits any family places it, if it is one family only.
    best = Window.partitionBy("node").orderBy("level")
    placed = cut(fits.withColumn("place", F.row_number().over(best)).where("place = 1"))
    taken = placed.where("family = last").select("node", "family")

    # Names without identifier that agree: masks are equal or one has none.
    left, right = (nodes.select(F.col("node").alias(s), F.col("name").alias(f"name_{s}"), F.col("mask").alias(f"mask_{s}")) for s in "ab")
    ends = left.join(both.select(F.col("x").alias("name_a"), F.col("y").alias("name_b")), "name_a")
    alike_names = ends.join(right, "name_b").where("a < b AND mask_a = '' OR a < b AND mask_b = ''").select("a", "b")
    alike_names = alike_names.unionByName(ends.withColumnRenamed("mask_a", "mask_b").where("mask_b <> ''").join(right, ["name_b", "mask_b"]).where("a < b").select("a", "b"))
    alike_names = cut(alike_names.distinct())
    # A name that fits no identified form, but a name that was placed, goes with it.
    either = alike_names.unionByName(alike_names.select(F.col("b").alias("a"), F.col("a").alias("b")))
    second = either.join(placed.select(F.col("node").alias("a")), "a", "left_anti").join(taken.select(F.col("node").alias("b"), "family"), "b")
    second = cut(second.groupBy(F.col("a").alias("node")).agg(F.min("family").alias("family"), F.max("family").alias("last")).where("family = last").select("node", "family"))
    free = alike_names
    for end in ("a", "b"):
        free = free.join(placed.select(F.col("node").alias(end)), end, "left_anti").join(second.select(F.col("node").alias(end)), end, "left_anti")
    taken = taken.unionByName(second)
    own = connected_components(free, "a", "b").select("node", F.col("component").alias("kin"))
    out = spelled.join(joined, "ident", "left").join(taken.withColumnRenamed("family", "fit"), "node", "left").join(own, "node", "left")
    lone = F.concat(F.lit("row:"), F.col("party_id").cast("string"))
    entity = F.when(F.col("ident") != "", F.concat(F.lit("id:"), F.coalesce("family", "ident"))).when(F.col("blank"), lone).when(F.col("fit").isNotNull(), F.concat(F.lit("id:"), F.col("fit"))).otherwise(F.concat(F.lit("name:"), F.coalesce("kin", "node")))
    return out.select("party_id", entity.alias("entity"))


def _of_agreeing_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fits = [agreement(Name.of_key(x), Name.of_key(y)) is not None for x, y in zip(batch.name_x, batch.name_y, strict=True)]
        yield batch.loc[fits, ["x", "y"]]


def entity_pairs(found: DataFrame) -> DataFrame:
    """(party_id_a, party_id_b): all pairs of rows of one entity."""
    a, b = (found.distinct().select(F.col("entity").alias(f"entity_{s}"), F.col("party_id").alias(f"party_id_{s}")) for s in "ab")
    return a.join(b, F.col("entity_a") == F.col("entity_b")).where("party_id_a < party_id_b").select("party_id_a", "party_id_b")
