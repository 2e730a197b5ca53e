"""Text expressions: tokens, question keys, chunks, sentences, predicates, HTML to text, privacy scrubbing.  All JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# The stop words of question tokens.
STOP_WORDS = tuple("the a an and or but is are was were be been being have has had do does did will would could should may might must can shall what why how when where who which this that these those it its of in on at to from for with by about into onto as so than then there here also just only any some all no not yes if else really".split())
#: Characters of scripts that are written without spaces.
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"

# Predicates by the words that name them, in order of precedence; a stem stands for itself alone.
PREDICATES = [
    ("requires_setup", "install|setup|set up|getting started"), ("configures", "configur|option|setting|parameter"), ("defines", "defin|what is|overview|introduc|describe"),
    ("has_architecture", "architec|design|structur|layer|component"), ("depends_on", "depend|require|prerequisit|need"), ("deprecates", "deprecat|remov|drop|obsolet"),
    ("addresses_issue", "error|bug|issue|problem|fix|troubleshoot"), ("demonstrates", "example|usage|how to|tutorial|guide"), ("exposes_api", "api|endpoint|route|method|function|interface"),
    ("tests", "test|spec|assert|expect|coverage"), ("affects_performance", "perform|optim|fast|slow|latency|throughput"), ("secures", "secur|auth|permission|token|credential"),
    ("migrates", "migrat|upgrad|version|changelog"), ("stores_data", "stor|databas|table|schema|sql|query"),
]

# What a scrub replaces, in order, and by what.
PRIVATE_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----", "[REDACTED_PRIVATE_KEY]")
BEARER = (r"\b[Bb]earer\s+[A-Za-z0-9._~+/=-]{20,}", "Bearer [REDACTED_TOKEN]")
TOKEN = "[REDACTED_TOKEN]"
TOKENS = [r"sk-ant-[A-Za-z0-9_-]{20,}", r"sk-[A-Za-z0-9]{20,}", r"github_pat_[A-Za-z0-9_]{80,}", r"ghp_[A-Za-z0-9]{36,}", r"AKIA[0-9A-Z]{16}", r"AIza[0-9A-Za-z_-]{35}", r"xox[baprs]-[A-Za-z0-9-]{10,}"]
CARD = (r"\b(?:[0-9][ -]?){13,19}\b", "[REDACTED_CC]")
ENVIRONMENT = (r"(?i)\b([A-Z_]*(?:SECRET|PASSWORD|PASSWD|TOKEN|APIKEY|API_KEY|ACCESS_KEY|PRIVATE_KEY|CLIENT_SECRET))\s*=\s*\S+", "=[REDACTED]")
PASSWORD = (r"(?i)\b(password|passwd)\s*[:=]\s*\S+", ":[REDACTED]")
STRICT = (r"\b[0-9]{13,19}\b", "[REDACTED_CC]")

# What every match of a rule holds, as plain strings, or as a pattern that is cheaper than the rule.
HOLDS = {PRIVATE_KEY[0]: ("-----BEGIN ", "PRIVATE KEY-----", "-----END "), BEARER[0]: ("earer",), ENVIRONMENT[0]: ("=",), **{p: (s,) for p, s in zip(TOKENS, ("sk-ant-", "sk-", "github_pat_", "ghp_", "AKIA", "AIza", "xox"))}}
MATCHES = {CARD[0]: r"[0-9](?:[ -]?[0-9]){12}", PASSWORD[0]: r"(?i)passw(?:or)?d\s*[:=]", STRICT[0]: r"[0-9]{13}"}

# Phrases by which somebody takes back what was said, in order of precedence.
CORRECTIONS = [
    ("zh.previous_was_wrong", r"我(之前|上次|刚才)(说|以为|提到)的.*?(错|不对|有误|不准)"), ("zh.actually_should_be", r"(实际上|其实)(应该|是)"), ("zh.scratch_that", r"(忽略|算了)(我|刚才)(说的|的话)"),
    ("en.i_was_wrong", r"(?i)\bI was wrong about\b"), ("en.correction_label", r"(?i)\bcorrection:\s"), ("en.scratch_that", r"(?i)\bscratch that\b"), ("en.actually", r"(?i)\bactually,?\s+(I|it|that)\b"),
]
#: What every match of such a phrase holds, in lower case; no i, whose lower case depends on the locale.
CORRECTION_HOLDS = {
    "zh.previous_was_wrong": ("我", "的"), "zh.actually_should_be": ("实",), "zh.scratch_that": ("的",),
    "en.i_was_wrong": ("wrong about",), "en.correction_label": ("correct", "on:"), "en.scratch_that": ("scratch that",), "en.actually": ("actually",),
}
#: Characters of a correction that are kept.
MOST_RETRACTED = 500


def java(pattern: str) -> str:
    r"""The pattern with ``\b`` between ASCII word characters and others, whatever the Java version takes for words."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def query_terms(text: Column) -> Column:
    """The distinct words of more than one character, as the keyword search takes them."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.length(w) > 1))


def question_tokens(text: Column) -> Column:
    """Lower-cased words longer than two characters that aren't stop words, and the character pairs of scripts without spaces; distinct, in order."""
    flat = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]+", " ")
    plain = lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)
    pairs = lambda run: F.when(F.length(run) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(run) - 1)), lambda k: F.substr(run, k, F.lit(2))))

    def parts(segment: Column) -> Column:
        cjk = F.flatten(F.transform(F.regexp_extract_all(segment, F.lit(f"[{CJK}]+"), 0), pairs))
        other = F.filter(F.regexp_extract_all(segment, F.lit(f"[^{CJK}]+"), 0), plain)
        return F.when(segment.rlike(f"[{CJK}]"), F.concat(cjk, other)).otherwise(F.filter(F.array(segment), plain))

    return F.array_distinct(F.flatten(F.transform(F.split(flat, r"\s+"), parts)))


def question_key(text: Column) -> Column:
    """Digest of a question without case, repeated white space and closing punctuation."""
    flat = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.sha2(F.trim(F.regexp_replace(flat, r"[?!.,;:]+$", "")), 256)


def chunks(text: Column, size: int = 800, overlap: int = 100) -> Column:
    """Structs (index, start, chunk): windows of ``size`` characters, ``overlap`` in common; one chunk if the text is short enough."""
    n, step = F.length(text), size - overlap
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    return F.transform(starts, lambda s, k: F.struct(k.alias("index"), s.alias("start"), F.substr(text, s + 1, F.lit(size)).alias("chunk")))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def first_sentences(text: Column, n: int = 3) -> Column:
    """The first sentences, or the first 300 characters of a text without any; without marks of emphasis, code and headings."""
    flat = strip(F.regexp_replace(text, r"[`*_#]", ""))

    def of(x: Column) -> Column:
        # behind the last stop there is no sentence, and a search for one would start at every character
        upto = F.regexp_extract(x, r"(?s)^(.*[.!?])", 1)
        found = F.transform(F.slice(F.regexp_extract_all(upto, F.lit(r"[^.!?]++[.!?]"), 0), 1, n), strip)
        return F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, F.array_join(f, " ")).otherwise(strip(F.left(x, F.lit(300)))))[0]

    return F.transform(F.array(flat), of)[0]  # bound once, lest the text is cleaned for every use


def whole_word(words_: str) -> str:
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{words_})(?:[^\p{{L}}\p{{N}}_]|$)"


def predicate(heading: Column, text: Column) -> Column:
    """What a paragraph says about its heading, by the first kind of word that the heading or the first 200 characters hold."""
    both = F.concat(heading, F.lit(" "), F.left(text, F.lit(200)))
    out = F.lit("describes")
    for name, words_ in reversed(PREDICATES):
        out = F.when(both.rlike(whole_word(words_)), name).otherwise(out)
    return out


def normalised(text: Column) -> Column:
    """Without tags; lines stripped, runs of blank lines as one, nothing around."""
    lines = F.split(F.regexp_replace(F.regexp_replace(text, r"<[^>]+>", ""), r"\r\n?", "\n"), "\n")
    return strip(F.regexp_replace(F.array_join(F.transform(lines, strip), "\n"), r"\n{3,}", "\n\n"))


def correction(text: Column) -> Column:
    """The name of the first pattern of a correction that the text holds; null: none.  Plain searches clear most texts."""
    out, low = F.lit(None).cast("string"), F.lower(text)
    for name, pattern in reversed(CORRECTIONS):
        held = reduce(Column.__and__, ((text if name.startswith("zh.") else low).contains(x) for x in CORRECTION_HOLDS[name]))
        out = F.when(held & text.rlike(java(pattern)), name).otherwise(out)
    return out


def plain_text(html: Column) -> Column:
    """Tags out, white space to one space: the fallback extraction."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"[ \t\n\r]+", " "))


def _held(column: str, pattern: str) -> Column:
    """False where the text surely has no match of a rule of the scrub."""
    held = F.col(column).rlike(MATCHES[pattern]) if pattern in MATCHES else F.lit(True)
    for what in HOLDS.get(pattern, ()):
        held = held & F.col(column).contains(what)
    return held


def _rewritten(df: DataFrame, pattern: str, judge, new) -> DataFrame:
    """Each match of the pattern in ``_t`` for which ``judge`` holds replaced by ``new`` of it, and counted in ``_n``."""
    hits = F.when(F.col("_t").rlike(java(pattern)), F.regexp_extract_all("_t", F.lit(java(pattern)), 0))
    d = df.withColumn("_hits", hits).withColumn("_pieces", F.when(F.col("_hits").isNotNull(), F.split("_t", java(pattern), -1)))
    other = F.transform("_hits", lambda h: F.when(judge(h), new(h)).otherwise(h))
    joined = F.array_join(F.zip_with("_pieces", F.concat(other, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    n = F.coalesce(F.size(F.filter("_hits", judge)), F.lit(0))
    return d.withColumn("_n", F.col("_n") + F.when(F.col("_hits").isNotNull(), n).otherwise(0)).withColumn("_t", F.when(F.col("_hits").isNotNull(), joined).otherwise(F.col("_t"))).drop("_hits", "_pieces")


def scrubbed(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """``df`` with secrets in ``column`` replaced, rule after rule, and ``redactions``, how many were.

    A card is 13 to 19 digits, with spaces or hyphens or without, whose check digit is right; ``strict`` takes any 13 to 19 digits in a
    row.  What a more specific rule has replaced is left alone by those after it.  A null stays null with 0 redactions; a column redactions is replaced.
    """
    columns = [c for c in df.columns if c != "redactions"]
    held = F.lit(False)
    for rule in (*HOLDS, *(r for r in MATCHES if strict or r != STRICT[0])):
        held = held | _held(column, rule)
    # rules pass over a null at once; plain searches tell which texts can be left alone, as hardly any text has a match
    d = df.select(F.struct(*columns).alias("_row"), F.when(held, F.col(column)).alias("_t"), F.lit(0).alias("_n"))
    for pattern, to in (PRIVATE_KEY, BEARER, *((p, TOKEN) for p in TOKENS)):
        d = d.withColumn("_n", F.col("_n") + F.coalesce(F.regexp_count("_t", F.lit(java(pattern))), F.lit(0))).withColumn("_t", F.regexp_replace("_t", java(pattern), to))
    d = _rewritten(d, CARD[0], lambda h: luhn_valid(F.regexp_replace(h, "[^0-9]", "")), lambda h: F.lit(CARD[1]))
    for pattern, to in (ENVIRONMENT, PASSWORD):
        d = _rewritten(d, pattern, lambda h: ~h.contains("REDACTED"), lambda h, pattern=pattern, to=to: F.concat(F.regexp_extract(h, java(pattern), 1), F.lit(to)))
    if strict:
        d = _rewritten(d, STRICT[0], lambda h: F.lit(True), lambda h: F.lit(STRICT[1]))
    return d.select(*(F.coalesce("_t", F.col("_row").getField(c)).alias(c) if c == column else F.col("_row").getField(c).alias(c) for c in columns), F.col("_n").cast("long").alias("redactions"))


def scrubbed_json(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """``scrubbed`` for JSON: what a redaction has broken becomes an object that holds the redacted text."""
    d = scrubbed(df, column, strict)
    return d.withColumn(column, F.when(F.try_parse_json(column).isNotNull() | F.col(column).isNull(), F.col(column)).otherwise(F.to_json(F.struct(F.col(column).alias("_redacted_raw")))))


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(digits)

    def add(total: Column, k: Column) -> Column:
        x = F.substr(digits, n - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


# Ports that a scheme has anyway.
PORTS = {"http": "80", "https": "443", "ws": "80", "wss": "443", "ftp": "21"}


def normal_url(url: Column) -> Column:
    """The address by which one page is one: trimmed, scheme and host in lower case, without the scheme's own port, a fragment, or a slash behind a bare host.

    Spaces and quotes become percent signs with their codes; path and query are otherwise kept.  Null where there is no scheme with a host.
    """
    bare = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]", ""), r"#.*$", "")
    head = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?\\]*@)?([^/?@:\\]+|\[[0-9A-Fa-f:.]+\])(?::([0-9]*))?(?=[/?]|$)"
    part = lambda k: F.regexp_extract(bare, head, k)
    scheme, port = F.lower(part(1)), F.regexp_replace(part(4), "^0+(?=[0-9])", "")
    own = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in PORTS.items() for x in kv)), scheme), F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substr(bare, F.length(part(0)) + 1), " ", "%20"), '"', "%22"), "<", "%3C"), ">", "%3E")
    rest = F.when(rest.startswith("/?"), rest).when(rest.startswith("?"), F.concat(F.lit("/"), rest)).when(rest == "/", "").otherwise(rest)
    port = F.when((port == "") | (port == own), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), part(2), F.lower(part(3)), port, rest))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; empty against empty is 0."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))
