"""Secret scans in DataFrame functions alone: candidates by patterns, false positives removed by a random forest.

Candidates are, by definition: bare runs of 12 or more letters, digits and + / _ - with up to two = behind them, wherever they stand (shorter
ones are too like words to be told by themselves); values behind a name that holds a secret word (password, token ...), however long the
name, with =, : or blanks between, however many; values behind any other = or :; and what stands between user and host in an address.
Values may have any length and any number of parts, and hold any symbols but blanks, quotes, < and >; they end before & ; , if a further
name with its = or : follows (without a secret word before any of & ; , = : ?), and closing punctuation behind them is not part of them.
Words that only name the kind of a secret (Bearer, KEY) are no values. Features are the length, shares of kinds of characters, transitions
between kinds, the share that dictionary words cover, whether the candidate stands in a path or address, and as context the 48 characters
before it, whatever other candidates these hold, and 24 behind; of longer names their secret word stands for them. The forest is trained on
labelled findings, at most `most` of them, on the driver, and becomes one SQL expression; documents are scanned row by row, and nothing
moves between tasks. Patterns never go back over what they have read, so a scan takes time in proportion to the text.

Null and empty texts have no findings. Texts are scanned whole, with all their candidates; of findings one within the other the longer
is given; rows that tie or repeat have the same findings again; empty tables give empty tables. scan() reads two columns only, so others
may have any names; redact() keeps all columns. Without labelled findings of both kinds every candidate is a finding."""

from __future__ import annotations

import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.common import free_name

_C = r"A-Za-z0-9+/_\-"
#: The first group is what a match holds before the candidate.
RUN = rf"()(?<![{_C}])[{_C}]{{12,}}(?:={{1,2}}(?![{_C}=\"'`]))?"
_WORDS = r"token|secret|passw|passphrase|pwd|api.?key|access.?key|auth(?!or(?!i[sz]))|credential|bearer|private|signature"
#: Characters of names, of values, and of values that closing punctuation does not end.
_R, _N, _M = r"[^\s=:\"'`]", r"[^\s\"'`<>&;,.:)\]}]", r"[^\s\"'`<>&;,=:?.)\]}]"
_SET = r"[\"'`]?(?:\s*+[=:]{1,2}>?\s*+|\s++)[\"'`]?"
_KIND = r"(?!(?i:bearer|basic|digest|token|keys?)\b-*+(?:\s|$))"
#: A name is read from its begin, or from where the value before it ends, and only once.
NAMED = rf"((?:\G|(?<!{_R}))(?={_R}*?(?i:{_WORDS})){_R}++{_SET}){_KIND}(?![&;,])(?:{_N}++|[&;,.:)\]}}]++(?={_N})(?!(?<=[&;,])\w++[=:]))++"
ASSIGNED = rf"([=:]>?\s*+[\"'`]?){_KIND}(?:{_M}++|[.)\]}}]++(?={_M}))++"
ADDRESS = r"(://[^\s/:@\"'`<>]*+:)[^\s/@\"'`<>]++(?=@)"
#: Frequent parts of names and prose; what they cover is less likely a secret.
DICTIONARY = "account address admin backup bank build cache class client code color config content count course customer data date default demo device document download draft email error event example export file final first form group guide handler height house image index info invoice item label large last left light line link list local login main manager message meta method model module month name network note number object order other output page part path person photo phone picture place plan point post price print product profile project query read record release report request response result right sample schema screen script section server service session size small source start state status storage street string style summary system table task temp test text thumb time title track type update upload user value version video view week width window world year".split()
BEFORE = r"(?i)(?:" + _WORDS + r")[^\s=:&;,]*\s*[=:]{0,2}>?\s*[\"'`]?$"
PLAIN = r"(?i)(commit|sha1|sha256|md5|checksum|digest|etag|uuid|guid|isbn|card|phone|tel|order|invoice|build|revision|version|hash|id|no|nr|number)\W{0,4}$"
FEATURES = ("length", "digits", "upper", "lower", "transitions", "letters_only_runs", "dictionary", "path", "assigned", "quoted", "secret_word", "plain_word", "hex", "variety", "symbols", "known_form", "address", "name")


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def features(c: Column, before: Column, after: Column) -> dict[str, Column]:
    """Numbers of a candidate c, the text before it and the text after it."""
    flag = lambda x: x.cast("double")
    kept = F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=len, reverse=True)), ""))
    return {
        "length": F.length(c).cast("double"),
        "digits": _share(c, "[0-9]"),
        "upper": _share(c, "[A-Z]"),
        "lower": _share(c, "[a-z]"),
        "transitions": _share(c, "[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])"),
        "letters_only_runs": _share(c, "[A-Za-z]{5,}"),
        "dictionary": 1 - kept / F.length(c),
        "path": flag(before.rlike(r"(://\S*|[./\\@~])$") | after.rlike(r"^[./\\@]\w") | c.rlike(r"^/|/[a-z]{3,}/")),
        "assigned": flag(before.rlike(r"[=:]\s?[\"'`]?$")),
        "quoted": flag(before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")),
        "secret_word": flag(before.rlike(BEFORE)),
        "plain_word": flag(before.rlike(PLAIN)),
        "hex": flag(c.rlike("^[0-9a-f]+$") | c.rlike("^[0-9A-F]+$")),
        "variety": F.size(F.array_distinct(F.split(c, ""))) / F.length(c),
        "symbols": _share(c, "[^A-Za-z0-9+/_=-]"),
        "known_form": flag(c.rlike(r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^xox[abp]-|^sk[-_]|^AIza|^eyJ")),
        "address": flag(before.rlike(r"://[^\s/:@]*:$") & after.rlike("^@")),
        "name": flag(after.rlike("^[\"'`]?\\s*[=:]")),
    }


class Forest:
    """Bagged Gini trees over a few features each; deterministic for a seed."""

    def __init__(self, trees: int = 15, depth: int = 6, least: int = 3, seed: int = 1):
        self.n, self.depth, self.least, self.rng, self.trees = trees, depth, least, np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        for _ in range(self.n):
            rows = self.rng.integers(0, len(y), len(y))
            self.trees.append(self._grow(x[rows], y[rows], self.depth))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> tuple | float:
        p = float(y.mean())
        if depth == 0 or len(y) < 2 * self.least or p in (0.0, 1.0):
            return p
        best = None
        for f in self.rng.permutation(x.shape[1])[: max(1, round(x.shape[1] ** 0.5)) + 1]:
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least)
            if not ok.any():
                continue
            a, b = ones[:-1], ones[-1] - ones[:-1]
            cost = np.where(ok, a * (n - a) / n + b * (len(y) - n - b) / (len(y) - n), np.inf)
            k = int(np.argmin(cost))
            if best is None or cost[k] < best[0]:
                best = (cost[k], int(f), float((v[k] + v[k + 1]) / 2))
        if best is None:
            return p
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict(self, row: np.ndarray) -> float:
        total = 0.0
        for t in self.trees:
            while not isinstance(t, float):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            total += t
        return total / max(len(self.trees), 1) if self.trees else 1.0

    def column(self, value) -> Column:
        """The same as an expression; value(i): feature i."""

        def node(t: tuple | float) -> Column:
            return F.lit(t) if isinstance(t, float) else F.when(value(t[0]) <= F.lit(t[1]), node(t[2])).otherwise(node(t[3]))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + node(t)
        return total / F.lit(float(len(self.trees))) if self.trees else F.lit(1.0)


def train(findings: DataFrame, most: int = 10_000, **how: int) -> Forest:
    """A forest from labelled findings (candidate, before, after, secret 0/1): the `most` of least hash, all if fewer."""
    c, b, a = (F.coalesce(F.col(x), F.lit("")) for x in ("candidate", "before", "after"))
    ready = findings.where(F.col("secret").isin(0, 1) & (F.length("candidate") > 0))
    ready = ready.orderBy(F.xxhash64("candidate", "before", "after"), "candidate", "before", "after", "secret").limit(most)
    rows = ready.select(*[x.cast("double") for x in features(c, b, a).values()], F.col("secret").cast("double")).collect()
    data = np.array([tuple(r) for r in rows], np.float64).reshape(-1, len(FEATURES) + 1)
    forest = Forest(**how)
    return forest.fit(data[:, :-1], data[:, -1]) if 0 < data[:, -1].sum() < len(data) else forest


def labelled_findings(spark: SparkSession, n: int = 4000, seed: int = 1) -> DataFrame:
    """Findings with labels: half generated credentials of common forms in the places where they leak, half look-alikes."""
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexes, b62, digits = "0123456789abcdef", string.ascii_letters + string.digits, string.digits
    syllables = "an en in er on the ti or al re st ma lo da ne ra si to ver ung keit que ment ci la".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    prose = lambda: " ".join(word() for _ in range(r.randint(0, 4)))
    name = lambda: r.choice(["token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth_token", "pwd", "client_secret"])
    sets = lambda: r.choice([" = \"", "=", ": ", ":", " = '", "=\"", " = ", " "])

    def secret() -> tuple[str, str]:
        k = r.randrange(10)
        value = [lambda: pick(hexes, r.choice([12, 16, 18, 20, 24, 32, 40, 64])), lambda: pick(b62, r.randint(16, 48)), lambda: "AKIA" + pick(string.ascii_uppercase + "234567", 16), lambda: "ghp_" + pick(b62, 36), lambda: pick(b62 + "+/", 43) + "=", lambda: "sk-" + pick(b62, r.randint(32, 48)), lambda: pick(b62 + "!#$%.@^*-_", r.randint(6, 20)) + pick(b62 + "!#$%", 1), lambda: pick(b62, r.randint(6, 15)), lambda: pick(string.ascii_letters, r.randint(8, 24)), lambda: (word() + pick(digits, r.randint(1, 4)) + pick(string.ascii_lowercase + "!#$", r.randint(0, 3))).rjust(6, "q")][k]()
        bare = k in (2, 3, 5) and r.random() < 0.7
        if r.random() < 0.06:
            return value.translate(str.maketrans("/@", "xx")), prose() + " " + r.choice(["postgres", "mysql", "https", "redis", "amqp"]) + "://" + word() + ":"
        if r.random() < 0.06:
            return value, prose() + r.choice([" Bearer ", " bearer ", " Authorization: Bearer "])
        return value, prose() + " " + ("" if bare else name() + sets())

    def other() -> tuple[str, str]:
        kinds = [
            lambda: (pick(digits, r.choice([12, 13, 16, 16, 19])), r.choice(["", "card ", "no. ", "order ", "id: ", "tel: "])),
            lambda: (pick(hexes, r.choice([40, 64])), r.choice(["commit ", "sha256: ", "checksum ", "digest=", "etag: "])),
            lambda: ("-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12)), r.choice(["uuid ", "id=", "guid: ", ""])),
            lambda: ("_".join(r.choice(DICTIONARY) for _ in range(r.randint(2, 4))) + r.choice(["_", "-", ""]) + pick(digits, r.randint(1, 8)), r.choice(["", "/home/", "src/", "file: "])),
            lambda: ("/".join([r.choice(DICTIONARY), r.choice(DICTIONARY), pick(digits, 4), r.choice(DICTIONARY)]), r.choice(["https://www.", "/", ""])),
            lambda: ("".join(r.choice(DICTIONARY).title() for _ in range(3)) + pick(digits, r.randint(1, 3)), ""),
            lambda: (word() + word() + word() + "abc" + pick(digits, r.randint(1, 4)), ""),
            lambda: (r.choice(["-", "_", "0", "1", "9", "x1"]) * r.randint(12, 40) + "1", ""),
            lambda: (pick(digits, 8) + "T" + pick(digits, 6), r.choice(["", "time: ", "date=", "version "])),
            lambda: (word() + "-" + word() + "-" + pick(digits, 4) + "-" + word(), r.choice(["", "https://", "www."])),
            lambda: ("+" + pick(digits, r.randint(11, 14)), r.choice(["", "phone ", "tel: "])),
            lambda: (r.choice([str.lower, str.title, str.upper])("".join(word() for _ in range(r.randint(3, 6))) + "ungen"), r.choice(["", "", "name: ", "title=", '"text": "'])),
            lambda: (r.choice(["_", "-", "/", ""]).join(r.choice([str.lower, str.title])(r.choice(DICTIONARY)) for _ in range(r.randint(2, 5))), r.choice(["", "/", "id=", "file: ", "https://www."])),
            lambda: ("//www." + word() + r.choice([".com", ".org/" + word(), ".de/" + word() + "/" + pick(digits, 4)]), r.choice(["https:", "http:"])),
            lambda: (r.choice([word(), r.choice(DICTIONARY), pick(digits, r.randint(1, 8)), word() + ".", word().title() + pick(digits, 2), pick(digits, 2) + "." + pick(digits, 2), pick(digits, 4) + "-" + pick(digits, 2)]), r.choice(["note: ", "name: ", "width=", "at 10:", "user = \"", "Re: ", "x=", "count: ", "a href=\""])),
            lambda: (r.choice(["null", "true", "false", "None", "required", "invalid", "expired", "****", "********", "${" + word() + "}", "{{" + word() + "}}", "self." + word(), "config.get(" + word() + ")", "os.environ[" + word() + "]", r.choice(DICTIONARY), "your_" + r.choice(DICTIONARY)]), name() + sets()),
            lambda: (r.choice([word(), word() + ",", "is", "for", "of", "the", "was", word() + word(), word() + "."]), name() + r.choice([" ", " ", "s ", ": "])),
            lambda: (r.choice("-_/+") * r.randint(12, 60), r.choice(["", ": ", "="])),
            lambda: (r.choice([str.upper, str.lower])(r.choice(["", "my_", "app_"]) + name() + r.choice(["", "_", "_of_the_"]) + r.choice([pick(digits, 1), r.choice(DICTIONARY)])), r.choice(["", "", "export ", "&", "--"])),
        ]
        value, before = r.choice(kinds)()
        return value, prose() + " " + before

    rows = []
    for i in range(n):
        value, before = secret() if i % 2 else other()
        quote = before[-1:] if before[-1:] in "\"'" and before[-1:] else ""
        if not i % 2 and any(w in value.lower() for w in ("token", "secret", "passw", "pwd", "key")) and "_" in value:
            after = r.choice(["=", " = ", ": ", '": "']) + word()
        else:
            after = "@" + word() + ".com" if before.endswith(":") and "://" in before else quote + r.choice([" ", ". ", ", ", "\n", " ", "### ", "%%% "]) + prose()
        rows.append((value, before[-48:], after[:24], i % 2))
    return spark.createDataFrame(rows, "candidate string, before string, after string, secret int")


def candidates(text: Column) -> Column:
    """An array of (parts, found, lead) of a text, one for each pattern: what stands between matches, the matches, and what each holds
    before its candidate, which is looked for in the match alone."""
    nothing = F.array().cast("array<string>")
    none = F.struct(F.array(text).alias("parts"), nothing.alias("found"), nothing.alias("lead"))

    def matches(p: str, may: Column | None = None) -> Column:
        found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        # what an address has behind its candidate is not in the match
        again = p.removesuffix("(?=@)")
        lead = (lambda f: F.lit("")) if p == RUN else (lambda f: F.regexp_extract(f, again, 1))
        out = F.struct(F.split(text, p, -1).alias("parts"), found.alias("found"), F.transform(found, lead).alias("lead"))
        return out if may is None else F.when(may, out).otherwise(none)

    # most texts hold no secret word and no address: one look at them instead of two
    return F.array(matches(RUN), matches(NAMED, text.rlike(f"(?i){_WORDS}")), matches(ASSIGNED, text.rlike("[=:]")), matches(ADDRESS, F.contains(text, F.lit("://")) & F.contains(text, F.lit("@"))))


def in_context(p: Column, judge) -> Column:
    """What judge makes of the (secret, begin, before, after) of each match of a pattern: arrays, put together."""

    def step(a: Column, x: Column) -> Column:
        n, so_far = F.length(x["lead"]), F.concat(a["tail"], x["part"])
        begin = a["at"] + F.length(x["part"]) + n
        secret = F.substring(x["found"], n + 1, F.length(x["found"]))
        word, mark = F.regexp_extract(x["lead"], f"(?i){_WORDS}", 0), F.regexp_extract(x["lead"], f"{_SET}$", 0)
        before = F.when(n <= 40, F.substring(F.concat(so_far, x["lead"]), -48, 48)).otherwise(F.substring(F.concat(word, mark), -48, 48))
        one = F.struct(secret.alias("secret"), begin.alias("begin"), before.alias("before"), F.substring(x["after"], 1, 24).alias("after"))
        tail = F.substring(F.concat(so_far, x["found"]), -48, 48)
        return F.struct((begin - n + F.length(x["found"])).alias("at"), tail.alias("tail"), F.concat(a["out"], judge(F.array(one))).alias("out"))

    part = lambda c, i: F.struct(c.alias("found"), F.get(p["lead"], i).alias("lead"), F.get(p["parts"], i).alias("part"), F.concat(F.get(p["parts"], i + 1), F.coalesce(F.get(p["found"], i + 1), F.lit(""))).alias("after"))
    none = F.filter(judge(F.array(F.struct(F.lit("x").alias("secret"), F.lit(0).alias("begin"), F.lit("").alias("before"), F.lit("").alias("after")))), lambda _: F.lit(False))
    return F.aggregate(F.transform(p["found"], part), F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), none.alias("out")), step, lambda a: a["out"])


def findings(text: Column, forest: Forest, threshold: float = 0.5) -> Column:
    """An array of (begin, left, secret, score) of a text, by begin, which counts characters from 0; left is the length below zero."""

    def judge(some: Column) -> Column:
        known = F.transform(some, lambda x: F.struct(x["secret"].alias("secret"), x["begin"].alias("begin"), *[v.cast("double").alias(k) for k, v in features(x["secret"], x["before"], x["after"]).items()]))
        scored = F.transform(known, lambda x: F.struct(x["begin"].alias("begin"), (-F.length(x["secret"])).alias("left"), x["secret"].alias("secret"), forest.column(lambda k: x[FEATURES[k]]).alias("score")))
        return F.filter(scored, lambda x: x["score"] >= threshold)

    found = F.array_sort(F.flatten(F.transform(candidates(text), lambda p: in_context(p, judge))))
    none = F.filter(F.array(F.struct(F.lit(0).alias("begin"), F.lit(0).alias("left"), F.lit("").alias("secret"), F.lit(0.0).alias("score"))), lambda _: F.lit(False))
    fresh = lambda a, x: F.filter(F.array(x), lambda y: y["begin"] - y["left"] > a["end"])
    step = lambda a, x: F.struct(F.greatest(a["end"], x["begin"] - x["left"]).alias("end"), F.concat(a["out"], fresh(a, x)).alias("out"))
    return F.aggregate(found, F.struct(F.lit(0).alias("end"), none.alias("out")), step, lambda a: a["out"])


def scan(docs: DataFrame, forest: Forest, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, begin, secret, score): a row for each finding."""
    return docs.select(F.col(key), F.explode(findings(F.col(text), forest, threshold)).alias("f")).select(key, F.col("f.begin").cast("long").alias("begin"), F.col("f.secret").alias("secret"), F.col("f.score").alias("score"))


def redact(docs: DataFrame, forest: Forest, text: str = "text", mask: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, their secrets replaced by the mask."""
    t, at = F.col(text), free_name(docs, "hits")
    hits = findings(t, forest, threshold)
    step = lambda a, x: F.struct(F.concat(a["done"], F.substring(t, a["at"] + 1, x["begin"] - a["at"]), F.lit(mask)).alias("done"), (x["begin"] + F.length(x["secret"])).alias("at"))
    out = F.aggregate(at, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), step, lambda a: F.concat(a["done"], F.substring(t, a["at"] + 1, F.length(t))))
    return docs.withColumn(at, hits).withColumn(text, F.when(F.size(at) > 0, out).otherwise(t)).drop(at)
