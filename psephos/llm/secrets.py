"""Secret scans in DataFrame functions: candidates by pattern, a random forest against false positives."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from psephos.llm.common import free_name, table, written

#: Candidates: a run of 20 such characters or more with up to two signs of padding; any value of 6 characters or more that is given to a name like password or token;
#: the password in an address; a private key's block.  What stands before a value is part of the match, so that a run cannot swallow a name.
_RUN = "A-Za-z0-9+/_"
_CANDIDATE = rf"(?<![{_RUN}-])[{_RUN}-]{{20,}}={{0,2}}"
_NAME = "(?i:passw(?:or)?d|passphrase|pwd|secret|token|auth|credential|key)"
_GIVEN = rf"(?<![{_RUN}.-])(?=[{_RUN}.-]*+[\"'`]?\s{{0,3}}[:=])[{_RUN}.-]*?{_NAME}[{_RUN}.-]{{0,40}}[\"'`]?\s{{0,3}}(?::=|=>|[:=])\s{{0,3}}(?:(?i:bearer|basic)\s{{1,3}})?[\"'`]?"
_VALUE = r"(?<=[\"'`])[^\s\"'`]{6,}(?=[\"'`])|[^\s\"'`]{5,}[^\s\"'`,;.)\]}>]"
_ADDRESS = r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s/:@\"'`]{0,64}:"
_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?s:.{1,65536}?)-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_ANY = rf"({_BLOCK})|({_GIVEN})({_VALUE})|({_ADDRESS})([^\s/@\"'`]{{3,}}(?=@))|({_CANDIDATE})"
#: Signs between matches and what lies between them, and within a match between what stands before the candidate and the candidate; in texts they count as spaces.
_EDGE, _MID = "\x01", "\x02"
#: A match has 9 characters at least, so so many pieces hold the 40 characters on either side of one.
_NEAR = 11

FEATURES = (
    "length", "digits", "upper", "lower", "marks", "turns", "hex", "known_pairs", "dictionary", "slashes", "in_path", "assigned", "near_secret", "near_other",
    "specials", "placeholder", "given", "address", "block", "named", "other_after",
)


def _quoted(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")" if values else "cast(array() as array<string>)"


def dictionary(docs: DataFrame, text: str = "text", words: int = 2000, least: int = 3, most: int = 40) -> list[str]:
    """The `words` most frequent words of `least` to `most` ASCII letters in all texts, lower-cased."""
    word = F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("word")
    counted = docs.select(word).where(F.length("word").between(least, most)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]


def _features(words: list[str], after: bool = False) -> str:
    """SQL for a struct of FEATURES of x, a struct of c (the candidate), b (what stands before it) and, with `after`, a (what follows)."""
    pairs = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    common = sorted(p for p, _ in pairs.most_common(150))
    n = "length(x.c)"
    share = lambda p: f"regexp_count(x.c, '{p}') / {n}"
    f = {
        "length": f"cast({n} as double)",
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share("[+/_=-]"),
        "turns": share("[a-z](?=[0-9A-Z])|[A-Z](?=[0-9a-z]{2})|[0-9](?=[A-Za-z])"),
        "hex": "cast(x.c rlike '^[0-9a-f]+$' as double)",
        "known_pairs": f"size(filter(regexp_extract_all(lower(x.c), '(?=([a-z]{{2}}))', 1), p -> array_contains({_quoted(common)}, p))) / {n}",
        "dictionary": f"aggregate(split(lower(x.c), '[^a-z]+'), 0, (a, w) -> a + if(length(w) >= 3 and array_contains({_quoted(words)}, w), length(w), 0)) / {n}",
        "slashes": share("/"),
        "in_path": "cast(x.b rlike '(://|[/.~])[^ ]*$' as double)",
        "assigned": r"cast(x.b rlike '[:=] {0,2}[\\x22\\x27\\x60]?$' as double)",
        "near_secret": "cast(x.b rlike '(?i)(token|secret|passw|api.?key|access.?key|auth|bearer|credential|private|signing|pwd|passphrase)' as double)",
        "near_other": "cast(x.b rlike '(?i)(sha-?[0-9]|commit|hash|uuid|digest|checksum|md5|integrity|etag|revision|example)' as double)",
        "specials": share("[^A-Za-z0-9+/_=-]"),
        "placeholder": r"cast(x.c rlike '^[$<{%(*\\[]|[(\\[{<]|^[A-Za-z_]+([.:][A-Za-z_]+)+$' as double)",
        "given": r"cast(x.b rlike '(?i)(passw|pwd|passphrase|secret|token|auth|credential|key)[a-z0-9_.-]*[\x22\x27\x60]? {0,3}(:=|=>|[:=])[^:=]*$' as double)",
        "address": "cast(x.b rlike '://[^ /@]*:$' as double)",
        "block": "cast(x.c rlike '^-----BEGIN ' as double)",
        "named": r"cast(x.c rlike '[A-Za-z]=$' and x.c not rlike '[0-9]' or x.a rlike '^[\x22\x27\x60]? {0,3}[:=]' as double)" if after else "0.0D",
        "other_after": "cast(x.a rlike '(?i)^[^a-z0-9]{0,4}(is |was |as )?(the )?(sha-?[0-9]|commit|hash|uuid|digest|checksum|md5|revision|example)' as double)" if after else "0.0D",
    }
    return "named_struct(" + ", ".join(f"'{k}', {f[k]}" for k in FEATURES) + ")"


def pieces(text: Column) -> Column:
    """The whole text cut at its candidates: plain, match, plain, ..., plain; a match is what stands before the candidate, _MID, and the candidate.  One pass over the text."""
    marked = F.regexp_replace(F.translate(text, _EDGE + _MID, "  "), F.lit(_ANY), F.lit(f"{_EDGE}$2$4{_MID}$1$3$5$6{_EDGE}"))
    return F.split(marked, _EDGE, -1)


def _matches(p: Column) -> Column:
    """Places of the matches among the pieces."""
    return F.when(F.size(p) > 2, F.sequence(F.lit(2), F.size(p) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))


def _parts(match: Column) -> tuple[Column, Column]:
    at = F.instr(match, _MID)
    return F.substring(match, F.lit(1), at - 1), F.substring(match, at + 1, F.length(match))


def candidates(text: Column) -> Column:
    """Array of structs c, b, a: every candidate of the whole text, in order, with up to 40 characters before and after it; empty for null.

    U+0001 and U+0002 count as spaces.
    """
    def found(p: Column):
        def one(i: Column) -> Column:
            before, c = _parts(F.element_at(p, i))
            first = F.greatest(F.lit(1), i - _NEAR)
            near = lambda start, n: F.translate(F.array_join(F.slice(p, start, n), ""), _MID, "")
            return F.struct(c.alias("c"), F.substring(F.concat(near(first, i - first), before), -40, 40).alias("b"), F.substring(near(i + 1, F.lit(_NEAR)), 1, 40).alias("a"))

        return F.transform(_matches(p), one)

    return F.coalesce(F.transform(F.array(pieces(text)), found)[0], F.array().cast("array<struct<c:string,b:string,a:string>>"))


def without(text: Column, secrets: Column, mark: str) -> Column:
    """The text with those of its candidates that are among `secrets` replaced where they were found."""
    def joined(p: Column):
        def one(piece: Column, i: Column) -> Column:
            before, c = _parts(piece)
            return F.when(i % 2 == 0, piece).otherwise(F.concat(before, F.when(F.array_contains(secrets, c), mark).otherwise(c)))

        return F.array_join(F.transform(p, one), "")

    return F.transform(F.array(pieces(text)), joined)[0]


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """n findings with their labels (c, b, a, secret, kind), from a rule: keys in the usual forms and places, and what is taken for keys.

    A site with findings that people have judged passes those instead; the columns are the same, a (what follows) may be missing.
    """
    h = lambda salt: f"sha2(concat('{salt}', id), 256)"
    mixed = lambda salt: f"regexp_replace(base64(unhex({h(salt)})), '[+/=]', '')"
    pick = lambda salt, *xs: f"element_at(array({', '.join(chr(39) + x + chr(39) for x in xs)}), cast(pmod(xxhash64('{salt}', id), {len(xs)}) as int) + 1)"
    size = lambda low, high: f"cast(pmod(xxhash64('size', id), {high - low + 1}) as int) + {low}"
    place = pick("p", "token = \"", "api_key: ", "secret=", "password: \"", "Authorization: Bearer ", "access_key = \"", "auth_token: \"", "client_secret = ")
    word = lambda salt: pick(salt, "garden", "value", "handler", "request", "index", "config", "station", "render", "update", "window", "listen", "component")
    words = f"concat({word('w1')}, initcap({word('w2')}), initcap({word('w3')}), initcap({word('w4')}))"
    sign, digit, char_quote = pick("sign", "!", "@", "#", "-", ".", "$", "%"), "cast(pmod(xxhash64('digit', id), 90) + 10 as string)", '"'
    given = pick("given", "password = \"", "password: ", "db_password=", "secret: ", "api_key = \"", "token: ", "key = ", "DB_PASSWORD=", "pwd=", "auth_token: \"", "client_secret = ")
    name = pick("name", "aws_secret_access_key", "AWS_SECRET_ACCESS_KEY", "GITHUB_PERSONAL_ACCESS_TOKEN", "stripe_live_secret_key", "DATABASE_MASTER_PASSWORD", "google_client_secret_value", "azure_storage_account_key", "SLACK_BOT_USER_OAUTH_TOKEN")
    kinds = {
        "hex key in its place": (f"substring({h('a')}, 1, {size(32, 64)})", place, 1),
        "mixed key in its place": (f"substring(concat({mixed('b')}, {mixed('b2')}), 1, {size(24, 60)})", place, 1),
        "prefixed key": (f"concat({pick('q', 'AKIA', 'ghp_', 'xoxb-', 'sk_live_', 'glpat-')}, substring({mixed('c')}, 1, {size(20, 36)}))", f"concat({pick('z', 'see ', 'was ', 'use ')}, {pick('y', '', 'key ', 'with ')})", 1),
        "digest": (f"substring({h('d')}, 1, {size(32, 40)})", pick("o", "commit ", "sha256:", "checksum ", "md5 ", "etag: ", "integrity=", "revision "), 0),
        "joined words": (words, pick("n", "the ", "call ", "in ", "and ", "token "), 0),
        "path": (f"concat_ws('/', {word('u1')}, {word('u2')}, {word('u3')}, {word('u4')})", pick("u", "https:/", "see ./", "http://a.b/", "path: "), 0),
        "uuid": (f"concat(substring({h('e')}, 1, 8), '-', substring({h('e')}, 9, 4), '-', substring({h('e')}, 13, 4), '-', substring({h('e')}, 17, 4), '-', substring({h('e')}, 21, 12))", pick("i", "uuid ", "id: ", "request-id ", "session "), 0),
        "repeated sign": (f"repeat({pick('r', '=', '-', '_', 'x', 'ha', 'no')}, {size(20, 40)})", pick("s", "", " ", "token ", "line "), 0),
        "long word": (f"concat(repeat({word('l1')}, 2), {word('l2')}, {word('l3')})", pick("t", "le ", "of ", "der ", "token: ", "secret "), 0),
        "short mixed password": (f"concat(substring({mixed('f')}, 1, 3), {sign}, {digit}, substring({mixed('f2')}, 1, {size(2, 12)}))", given, 1),
        "word password": (f"concat(initcap({word('v1')}), {pick('x1', '', '-', '_', '.')}, {digit}, {pick('x2', '42', '7', '2024', '!', '9!', 'xYz')})", given, 1),
        "password in an address": (f"concat({pick('y1', '', 'pw', 'Pass')}, substring({mixed('g')}, 1, {size(4, 16)}), {digit})", f"concat({pick('y2', 'postgres', 'https', 'mysql', 'amqp', 'redis')}, '://', {word('v2')}, ':')", 1),
        "key block": (f"concat('-----BEGIN ', {pick('y3', '', 'RSA ', 'EC ', 'OPENSSH ')}, 'PRIVATE KEY-----', char(10), {mixed('k')}, {mixed('k2')}, char(10), '-----END PRIVATE KEY-----')", pick("y4", "", "key: ", "the file "), 1),
        "word after a name": (f"concat({word('v3')}, {pick('x3', '', '', 's', '-only')})", given, 0),
        "expression after a name": (f"concat({pick('x4', '${', 'os.environ[', 'get_', 'config.', 'self.', '<your-', 'settings.')}, {word('v4')}, {pick('x5', '()', '}', '>', '', ']', '_name')})", given, 0),
        "long name": (f"concat({name}, {pick('x6', '', '', '=')})", pick("x7", "", "export ", "set ", "the ", "secret "), 0),
        "hex key after a long name": (f"substring({h('m')}, 1, {size(32, 64)})", f"substring(concat({name}, {pick('x8', '=', ' = ', ': ', ':')}, {pick('x9', '', char_quote)}), -40, 40)", 1),
        "mixed key after a long name": (f"substring(concat({mixed('n')}, {mixed('n2')}), 1, {size(24, 60)})", f"substring(concat({name}, {pick('x8', '=', ' = ', ': ', ':')}, {pick('x9', '', char_quote)}), -40, 40)", 1),
        "bare digest": (f"substring({h('o')}, 1, {size(32, 40)})", pick("z1", "in ", "see ", "", "("), 0),
    }
    later = {"password in an address": "'@db.example.org/x'", "long name": f"if({kinds['long name'][0]} like '%=', '4f2a', {pick('z2', ' = ', '=', ': ', ' ')})", "bare digest": pick("z3", " is the commit", " commit", " (sha1)", " checksum of it")}
    after = "case " + " ".join(f"when id % {len(kinds)} = {k} then {later[name]}" for k, name in enumerate(kinds) if name in later) + f" else {pick('z4', ' ', '', ' and more', ' end')} end"
    case = lambda xs: "case " + " ".join(f"when id % {len(kinds)} = {k} then {x}" for k, x in enumerate(xs)) + " end"
    c, b, label = zip(*kinds.values())
    return spark.range(n).selectExpr(f"{case(c)} as c", f"{case(b)} as b", f"{after} as a", f"{case(label)} as secret", f"{case([repr(k) for k in kinds])} as kind")


def _tree_sql(lines: list[str]) -> str:
    """One tree's printed form -> nested conditions; a leaf is its vote for 'secret'."""
    line = lines.pop(0)
    if m := re.match(r"Predict: ([\d.eE+-]+)", line):
        return m[1]
    m = re.match(r"If \(feature (\d+) <= ([\d.eE+-]+)\)", line)
    left = _tree_sql(lines)
    lines.pop(0)  # Else
    right = _tree_sql(lines)
    return f"if(f.{FEATURES[int(m[1])]} <= {float(m[2])!r}D, {left}, {right})"


def fit_forest(findings: DataFrame, words: list[str], trees: int = 24, depth: int = 6, seed: int = 11) -> str:
    """SQL for the share of trees that call f, a struct of FEATURES, a secret.  Trained from labelled findings (c, b, secret)."""
    after = "a" in findings.columns
    rows = findings.select(F.expr(f"transform(array(struct({'c, b, a' if after else 'c, b'})), x -> {_features(words, after)})[0]").alias("f"), F.col("secret").cast("double").alias("label")).select("f.*", "label")
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(written(rows, "findings"))
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(data)
    votes = [_tree_sql([x.strip() for x in t.toDebugString.splitlines()[1:]]) for t in model.trees]
    return "(" + " + ".join(votes) + f") / {len(votes)}D"


def scan(docs: DataFrame, findings: DataFrame | None = None, text: str = "text", words: int = 2000, to: str = "findings") -> DataFrame:
    """docs with an array column `to`: for every candidate of the whole text a struct c, b, a, score.  No row moves: all is computed where the text is read.

    The dictionary is the corpus's own most frequent words; the forest becomes conditional expressions, trained from `findings` (labelled_findings if None).
    Null and empty texts have an empty array; a text of any length is read once.  Equal candidates of a text are listed each, in order; repeated rows are scanned each.
    Other columns, null or not, stay as they are, but a column named as `to` (whatever its case) is replaced.  An empty table gives no rows.
    """
    known = dictionary(docs, text, words)
    forest = fit_forest(labelled_findings(docs.sparkSession) if findings is None else findings, known)
    return with_findings(docs, known, forest, text, to)


def with_findings(docs: DataFrame, known: list[str], forest: str, text: str, to: str) -> DataFrame:
    found = docs.withColumn(to, candidates(F.col(text)))
    found = found.withColumn(to, F.expr(f"transform(`{to}`, x -> named_struct('c', x.c, 'b', x.b, 'a', x.a, 'f', {_features(known, True)}))"))
    return found.withColumn(to, F.expr(f"transform(`{to}`, y -> named_struct('c', y.c, 'b', y.b, 'a', y.a, 'score', transform(array(y.f), f -> {forest})[0]))"))


def redacted(docs: DataFrame, text: str = "text", threshold: float = 0.5, mark: str = "[SECRET]", **options) -> DataFrame:
    """docs with every secret found in text replaced by mark; the columns stay, and a column n_chars follows the text's new length.

    A candidate goes where it was found if it, or an equal one of the same text, scores `threshold` or more; the same letters inside longer candidates or words stay.
    A text without secrets, null and empty ones among them, stays as it is; in one with secrets, U+0001 and U+0002 become spaces.  Columns may have any names.
    """
    to = free_name(docs, "found")
    out = scan(docs, text=text, to=to, **options)
    hits = F.transform(F.filter(F.col(to), lambda s: s["score"] >= threshold), lambda s: s["c"])
    out = out.withColumn(to, hits)
    hit = F.size(to) > 0
    out = out.withColumn(text, F.when(hit, without(F.col(text), F.col(to), mark)).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length(text)).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*docs.columns)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate: doc_id, its place in the document, SHA-256 instead of the candidate itself, score, and whether it is a secret."""
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = out.select("doc_id", F.posexplode("findings").alias("place", "x"))
    return rows.select("doc_id", "place", F.sha2("x.c", 256).alias("sha256"), F.length("x.c").alias("length"), "x.score", (F.col("x.score") >= 0.5).alias("is_secret"))
