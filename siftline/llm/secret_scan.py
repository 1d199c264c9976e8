"""Secret scans with a random forest that removes false positives, in SQL functions alone.

Candidates are private key blocks, the values of 8 or more characters (quoted ones with whatever they hold) that follow a credential-like
name and a sign of assignment, and long tokens that hold a digit or mixed case. Each has
features of its length, its character transitions, the share of it that dictionary words cover, what makes it a path, and
the words beside it. The forest is trained in numpy on labelled findings, made by ``labelled_findings`` from the
formats and the look-alikes listed there (the corpus has none), whose features come from the same SQL expressions; it scores as
nested CASE expressions. Candidates that half of its votes call secret are findings. A row's candidates stay an array in that
row from the search to the result: nothing is shuffled, and rows that share an id or have none keep their own findings.

Defined results: null text is empty and has none; repeated rows get equal results; a null doc_id is allowed; candidates in very long texts
are all looked at; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import random
import string
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.spans import occurrences
from siftline.sources.reading import table

TREES, DEPTH, LEAST, SEED = 25, 8, 4, 11
FINDINGS = 4000
#: Characters looked at before and after a candidate.
BESIDE = 48
_CHAR = r"A-Za-z0-9+/_=.~%:@-"
NAMES = r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|auth|bearer|credentials?|key)"
_SIGN = r"[\"']?[\x20\t]{0,3}(?::=|=>|[=:])[\x20\t]{0,3}"
#: A credential-like name, which may be part of a longer one, and a sign of assignment.
_NAME = rf"(?=[aAbBcCkKpPsStT])(?i:{NAMES})[A-Za-z0-9_.-]{{0,40}}?{_SIGN}"
_NAMED = rf"[A-Za-z0-9_.-]{{0,80}}?{_NAME}"
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*+(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?+"
ASSIGNED = rf"{_NAME}(?:\"[^\"\n]{{8,}}+\"|'[^'\n]{{8,}}+'|[^\s\"'<>]{{8,}}+)"
#: A run of token characters of at least 12 that is not itself the name of what follows: shorter ones are looked at with a name alone.
TOKEN = (
    rf"(?<![{_CHAR}])[{_CHAR}]{{12,}}+(?!(?<=(?i:{NAMES})[A-Za-z0-9_.-]{{0,20}}){_SIGN}|(?<=(?i:{NAMES})[A-Za-z0-9_.-]{{0,20}}[=:]{{1,2}})[\x20\t]{{0,3}}[^\s<>])"
)
CANDIDATE = f"{BLOCK}|{ASSIGNED}|{TOKEN}"
#: Words that names, paths and identifiers are made of.
DICTIONARY = (
    "about access account action active admin agent alert alias allow application archive array article assets async attribute author backup base batch binary block board branch browser buffer build button cache call center change channel check child class "
    "client cloud cluster code collection column command comment common component config connection console container content context control controller copy core count country create current data database date default delete "
    "demo deploy description design detail device display document domain download driver dummy edit element email enable engine entity entry error event example export factory field file filter final format frame function gateway group "
    "handle header hello history home host html image import index info input install instance internal item json label language layer layout legacy library line link list load local location logger login machine main manager master message method "
    "metric model module monitor name network node notify number object offset option order output package page param partition password path pattern payload placeholder player plugin pointer policy pool port prefix private process product profile project property provider public "
    "query queue random record release remote render report request resource response result return route sample schema script search section secret security select server service session setting shared simple site size source static status storage store stream string style system table target task template test "
    "text theme thread time title token tool total track type update upload user util value version video view visitor website window worker world your"
).split()
FEATURES = (
    "length", "changes", "digits", "uppers", "hexes", "kinds", "covered", "slashes", "dots", "path", "named", "hashed", "dummy", "provider", "vowels", "repeats", "letters", "dashed",
    "password", "quoted", "spaces", "symbols", "code",
)


def features(value: Column, before: Column, after: Column) -> list[Column]:
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    part = lambda pattern: F.regexp_count(value, F.lit(pattern)).cast("double") / size
    low, near = F.lower(value), F.lower(F.concat(before, F.lit(" "), after))
    words = "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w)))
    flag = lambda c: c.cast("double")
    return [
        size,
        part(r"[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"),
        part("[0-9]"),
        part("[A-Z]"),
        flag(value.rlike("^[0-9a-fA-F]+$")),
        F.size(F.array_distinct(F.split(value, ""))).cast("double") / size,
        1 - F.length(F.regexp_replace(low, words, "")).cast("double") / size,
        part("/"),
        part(r"\."),
        flag(low.rlike(r"^(?:[a-z]+:)?//|^[.~]?/|\.(?:[a-z]{2,4}|json|html|yaml)(?:$|[?#])|^[a-z]:|@[a-z0-9-]+\.[a-z]")),
        flag(F.lower(before).rlike(rf"{NAMES}(?:[^a-z0-9]{{0,4}}|[a-z0-9_.-]{{0,40}}[\"']?[\x20\t]{{0,3}}(?::=|=>|[=:])[\x20\t]{{0,3}}[\"']?)$")),
        flag(near.rlike(r"sha-?(?:1|2|256|512)|md5|commit|checksum|digest|integrity|revision|uuid|guid|fingerprint|etag|hash")),
        flag(F.concat(low, F.lit(" "), near).rlike(r"example|placeholder|changeme|your[_-]|dummy|xxxx|sample|\*{3}|1234567890|<[a-z]")),
        flag(value.rlike(r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^sk[-_][A-Za-z0-9_-]{16,}|^xox[abprs]-|^AIza[A-Za-z0-9_-]{30,}|^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.|^glpat-|^npm_[A-Za-z0-9]{30,}|^-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
        part("[aeiouAEIOU]"),
        part(r"(.)\1"),
        part("[a-zA-Z]"),
        flag(value.rlike(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^[0-9][0-9 .:/-]*$")),
        flag(F.lower(before).rlike(r"(?:pass|pwd|secret|credential)[a-z0-9_.-]{0,40}[\"']?[\x20\t]{0,3}(?::=|=>|[=:])[\x20\t]{0,3}[\"']?$")),
        flag(before.rlike("[\"']$")),
        part(r"\s"),
        part(r"[^A-Za-z0-9\s]"),
        flag(value.rlike(r"[({\[$<][A-Za-z_]|\(\)|^[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+$")),
    ]


def candidates(text: Column) -> Column:
    """Array of (s, e, v, before, after): candidates' values, names and quotes cut off, with what stands beside them."""
    has = lambda x: x.rlike("[0-9]") | x.rlike("[a-z][A-Z].*[a-z][A-Z]|[A-Z]{16}")
    found = F.filter(occurrences(text, CANDIDATE, "secret"), lambda x: x["v"].startswith("-----BEGIN ") | has(x["v"]) | x["v"].rlike(f"^{_NAMED}"))

    def cut(x: Column) -> Column:
        block = x["v"].startswith("-----BEGIN ")
        name = F.when(block, 0).otherwise(F.length(F.regexp_extract(x["v"], f"^{_NAMED}[\"']?", 0)))
        quoted = F.when(block, False).otherwise(x["v"].rlike(f"^{_NAMED}[\"']"))
        end = F.when(block | x["v"].rlike("[A-Za-z0-9+/]={1,2}$"), 0).when(quoted, 1).otherwise(F.length(F.regexp_extract(x["v"], r"[.:=,;)\]}]*$", 0)))
        s, e = x["s"] + name, x["e"] - end
        back = F.least(F.lit(BESIDE), s)
        return F.struct(s.alias("s"), e.alias("e"), F.substring(text, s + 1, e - s).alias("v"), F.substring(text, s - back + 1, back).alias("before"), F.substring(text, e + 1, F.lit(BESIDE)).alias("after"))

    return F.filter(F.transform(found, cut), lambda x: x["e"] - x["s"] >= 8)


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, int]]:
    """(before, value, after, label): half secrets of common formats, half look-alikes."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    alnum, hexes = string.ascii_letters + string.digits, "0123456789abcdef"
    syllables = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve qu eau ier ung sch ción os ado".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(2, 5)))
    # words of hashes and samples stand near secrets, too, if less often
    prose = lambda: " ".join(rng.choice(["hash", "etag", "commit", "digest", "sample", "example"]) if rng.random() < 0.03 else word() for _ in range(4))
    names = ["password", "passwd", "token", "secret", "api_key", "apikey", "access_key", "client_secret", "auth_token", "private_key"]
    signs = ['="', " = ", "=", ": ", ' = "', "='", ":"]

    def strong() -> str:
        return f"{prose()} {rng.choice(['password', 'passwd', 'DB_PASSWORD', 'admin_pwd', 'client_secret', 'passphrase'])}{rng.choice(['=', ' = ', ': ', ' := ', ':'])}{quote}"

    def secret() -> tuple[str, str]:
        name = f"{prose()} {rng.choice(names)}{rng.choice(signs)}"
        kind = rng.randrange(13)
        if kind == 0:
            return prose() + " ", rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + rng.choice([string.digits, "27", ""]), 16)
        if kind == 1:
            return rng.choice([prose() + " ", name]), "ghp_" + pick(alnum, 36)
        if kind == 2:
            return rng.choice([prose() + " ", name]), "sk-" + pick(alnum, rng.randint(24, 48))
        if kind == 3:
            return rng.choice([prose() + " ", name]), "eyJ" + pick(alnum, 20) + "." + pick(alnum, 40) + "." + pick(alnum + "_-", 43)
        if kind in (4, 5):
            return name, pick(rng.choice([hexes, hexes + string.digits]), rng.choice([16, 18, 20, 24, 32, 40, 64]))
        if kind == 6:
            return name, pick(alnum + "+/", rng.choice([20, 24, 32, 40, 44]))
        if kind == 7:
            return name, pick(alnum, rng.randint(8, 24))
        if kind == 8:
            return strong(), pick(alnum + "!#$%&*@^", rng.randint(8, 20))
        if kind == 9:  # a word or two with figures and signs, as people choose them
            return strong(), rng.choice([word().capitalize(), word()]) + rng.choice("!#$%*_-") + rng.choice([word(), word().capitalize()]) + str(rng.randint(1, 2050)) + rng.choice(["", "!", "#"])
        if kind == 10:
            return strong(), rng.choice(["", "-", "_"]).join(word() for _ in range(rng.randint(3, 5)))
        if kind == 11:
            head = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
            return prose() + " ", f"-----BEGIN {head}PRIVATE KEY-----\n" + "\n".join(pick(alnum + "+/", rng.choice([64, 64, rng.randint(8, 64)])) for _ in range(rng.randint(1, 20))) + f"\n-----END {head}PRIVATE KEY-----"
        return prose() + " ", rng.choice(["AIza" + pick(alnum + "_-", 35), "xoxb-" + pick(string.digits, 12) + "-" + pick(alnum, 24), "npm_" + pick(alnum, 36), "glpat-" + pick(alnum, 20)])

    def other() -> tuple[str, str]:
        kind = rng.randrange(17)
        some = [rng.choice(DICTIONARY) for _ in range(rng.randint(2, 5))]
        if kind == 0:
            return rng.choice(["commit ", "sha256:", "md5 ", "checksum ", "integrity sha512-", "revision "]), pick(hexes, rng.choice([32, 40, 64]))
        if kind == 1:
            return rng.choice(["id ", "uuid ", prose() + " "]), str(uuid.UUID(int=rng.getrandbits(128)))
        if kind == 2:
            return prose() + " ", "/" + "/".join(some) + rng.choice([".py", ".html", "", ".json", "/v2"])
        if kind == 3:
            return prose() + " ", f"https://{some[0]}.example.com/{'/'.join(some[1:])}/{rng.randint(1, 9999)}"
        if kind == 4:
            return prose() + " ", "".join(w.capitalize() for w in some) + rng.choice(["", "2", "V1", "64"])
        if kind == 5:
            return prose() + " ", "_".join(some) + rng.choice(["_1", "_v2", "2024"])
        if kind == 6:
            return f"{rng.choice(names)}{rng.choice(signs)}", rng.choice(["changeme1234", "your_api_key_here1", "xxxxxxxxxxxxxxxx", "example-password1", "placeholder_token_1", "1234567890", "test" + rng.choice(some) + "1"])
        if kind == 7:
            return prose() + " ", rng.choice([pick(string.digits, rng.randint(12, 19)), f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}T10:{rng.randint(10, 59)}:00"])
        if kind == 8:
            return prose() + " ", word() + word() + word() + rng.choice(["", "1", "2.", "%%%", "."])
        if kind == 9:
            return prose() + " ", f"{word()}.{rng.randint(1, 99)}@{word()}{rng.randint(1, 9)}.example.com"
        if kind == 10:
            return prose() + " ", ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 11:
            return prose() + " ", (word() + word() + word() + word()).upper() + rng.choice(["", "1"])
        if kind == 13:  # what a setting's name is followed by, other than a value
            return f"{prose()} {rng.choice(names + ['key', 'auth', 'author', 'keyword'])}{rng.choice([': ', ' = ', '='])}{quote}", rng.choice([rng.choice(some) + rng.choice(some), word() + word(), "required", "disabled", "(optional)", "undefined", some[0] + "_id", ".".join(some)])
        if kind == 14:
            return f"{prose()} {rng.choice(names)}{rng.choice([' = ', '=', ': '])}{quote}", rng.choice([f"${{{'_'.join(some).upper()}}}", f"os.environ[{some[0].upper()}", f"get_{some[0]}({some[1]})", f"{{{{ {some[0]}_{some[1]} }}}}", f"config.{some[0]}.{some[1]}", f"${some[0].upper()}_{some[1].upper()}", f"<your-{some[0]}>", f"load_{some[0]}()"])
        if kind == 15:
            return f"{prose()} {rng.choice(['key', 'token', 'author', 'auth', 'password', 'keynote', 'secret'])}{rng.choice([': ', ' = ', '='])}{rng.choice(chr(34) + chr(39))}", " ".join(word() for _ in range(rng.randint(2, 12))) + rng.choice(["", ".", "?"])
        if kind == 16:
            return f"{prose()} {rng.choice(['key', 'Key', 'keyword', 'author', 'token', 'auth'])}{rng.choice([': ', ':'])}", rng.choice([word() + word(), word().capitalize() + word(), "-".join([word(), word()]), word() + word() + "."])
        return prose() + " ", "-".join(some) + f"-{rng.randint(1, 99)}.{rng.randint(0, 9)}"

    out = []
    for i in range(n):
        quote = rng.choice(['"', '"', "'", ""])
        before, value = (secret if i % 2 else other)()
        out.append((before[-BESIDE:], value, rng.choice(['"', " ", ""]) + " " + prose(), i % 2))
    return out


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH) -> tuple:
    """A tree (feature, cut, left, right), or a leaf's share of secrets: least Gini impurity over a random half of the features."""
    if depth == 0 or len(y) < 2 * LEAST or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for f in rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], y[order]
        n = np.arange(1, len(t))
        ones = np.cumsum(t)[:-1]
        a, b = ones / n, (t.sum() - ones) / (len(t) - n)
        cost = n * a * (1 - a) + (len(t) - n) * b * (1 - b)
        cost[(v[1:] == v[:-1]) | (n < LEAST) | (len(t) - n < LEAST)] = np.inf
        k = int(cost.argmin())
        if np.isfinite(cost[k]) and (best is None or cost[k] < best[0]):
            best = (cost[k], int(f), float((v[k] + v[k + 1]) / 2))
    if best is None:
        return (float(y.mean()),)
    _, f, cut = best
    left = x[:, f] <= cut
    return (f, cut, grow(x[left], y[left], rng, depth - 1), grow(x[~left], y[~left], rng, depth - 1))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> list[tuple]:
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        at = rng.integers(len(y), size=len(y))
        out.append(grow(x[at], y[at], rng))
    return out


def _case(tree: tuple, column: str) -> str:
    if len(tree) == 1:
        return f"{tree[0]!r}D"
    f, cut, left, right = tree
    return f"CASE WHEN {column}[{f}] <= {cut!r}D THEN {_case(left, column)} ELSE {_case(right, column)} END"


def vote(forest: list[tuple], column: str) -> Column:
    """``column``, an array of (s, e, v, x), as an array of (s, e, v, chance): the trees' mean share of secrets for features x."""
    # within a higher-order function the trees are evaluated as they are: as generated code they outgrow a Java method
    chance = "(" + " + ".join(_case(t, "z.x") for t in forest) + f") / {len(forest)}D"
    return F.expr(f"transform({column}, z -> named_struct('s', z.s, 'e', z.e, 'v', z.v, 'chance', {chance}))")


@lru_cache(maxsize=4)
def _trained(n: int, seed: int, app: str) -> tuple:
    spark = SparkSession.getActiveSession()
    rows = spark.createDataFrame(labelled_findings(n, seed), "before string, v string, after string, label int")
    got = rows.select("label", F.array(*features(F.col("v"), F.col("before"), F.col("after"))).alias("x")).collect()
    return tuple(train(np.array([r[1] for r in got]), np.array([r[0] for r in got], float)))


def scanned(docs: DataFrame, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """(doc_id, found): a row a document, found the array of (s, e, v, chance) of its candidates."""
    forest = _trained(n, seed, docs.sparkSession.sparkContext.applicationId)
    measured = lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["v"].alias("v"), F.array(*features(c["v"], c["before"], c["after"])).alias("x"))
    rows = docs.select("doc_id", F.transform(candidates(F.coalesce(F.col("text").cast("string"), F.lit(""))), measured).alias("_c"))
    return rows.select("doc_id", vote(list(forest), "_c").alias("found"))


def scan(docs: DataFrame, n: int = FINDINGS, seed: int = SEED) -> DataFrame:
    """(doc_id, s, e, v, chance) of all candidates."""
    return scanned(docs, n, seed).select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, spans): how many candidates there are, and the findings the forest keeps with their places."""
    rows = scanned(docs).select("doc_id", F.size("found").cast("long").alias("n_candidates"), F.filter("found", lambda c: c["chance"] >= 0.5).alias("kept"))
    at = F.transform("kept", lambda c: F.concat_ws(":", c["s"].cast("string"), c["e"].cast("string")))
    return rows.select("doc_id", "n_candidates", F.size("kept").cast("long").alias("n_secrets"), F.array_join(at, ",").alias("spans"))


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents: their candidates, the findings the forest keeps, and the findings' places."""
    return secrets(table(spark, sf_dir, "documents"))
