"""Requests in free text as typed intents, by key words and patterns, as Spark expressions.

An intent is (action, rule_id, count, bucket). Words are tried in a fixed order; the first kind that fits counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lapidary.functions import fixed
from lapidary.functions.text import _col, let, strip

_STRINGS = "array<string>"


def has_any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def numeral(c: Column) -> Column:
    """A Chinese numeral up to 99; 1 where it isn't one."""
    digits = F.create_map(*[F.lit(x) for pair in fixed.NUMERALS.items() for x in pair])
    one = F.try_element_at(digits, c)
    tens, ones = F.split_part(c, F.lit("十"), F.lit(1)), F.split_part(c, F.lit("十"), F.lit(2))
    with_tens = F.when(tens == "", 1).otherwise(F.coalesce(F.try_element_at(digits, tens), F.lit(1))) * 10 + F.when(ones == "", 0).otherwise(F.coalesce(F.try_element_at(digits, ones), F.lit(0)))
    return F.when(one.isNotNull(), one).when(F.contains(c, F.lit("十")), with_tens).otherwise(F.coalesce(one, F.lit(1)))


def asked_count(c: Column | str) -> Column:
    """How many items a request asks for: digits before a unit, ``each N``, a verb before digits, or a numeral before a unit; else null."""
    q = _col(c)
    number = lambda pattern: F.try_to_number(F.nullif(F.regexp_extract(q, pattern, 1), F.lit("")), F.lit("999999999")).cast("int")
    han = F.nullif(F.regexp_extract(q, "([零一两二三四五六七八九十]+)\\s*(?:个|道|题|条|次)", 1), F.lit(""))
    return F.coalesce(
        number("([0-9]{1,9})\\s*(?:个|道|题|条|次|puzzle|each)"),
        number("(?:each|per)\\s+([0-9]{1,9})"),
        number("(?:give\\s+me|give|generate|make|create|want|add|need)\\s+([0-9]{1,9})"),
        F.when(han.isNotNull(), numeral(han)),
    )


def rule_ids(c: Column | str) -> Column:
    """Rules named in a request: by name, after "rule", else bare numbers 1 to 25 that aren't counts. In numeric order."""
    q = F.lower(_col(c))
    named = F.array_compact(F.array(*[F.when(F.contains(q, F.lit(name)), F.lit(rule)) for name, rule in fixed.RULE_NAMES.items()]))
    id_ = "(?:1[0-9]|2[0-5]|[1-9])"
    clauses = F.regexp_extract_all(q, F.lit(f"(?:rules?|规则)\\s*({id_}(?:[\\s,，、]*(?:and|和|与|及)?[\\s,，、]*{id_})*)"), 1)
    after = F.flatten(F.transform(clauses, lambda x: F.regexp_extract_all(x, F.lit(f"({id_})"), 1)))
    found = F.array_distinct(F.concat(named, after))
    words = F.regexp_extract_all(q, F.lit(r"[\p{L}\p{N}_]+"), 0)
    bare = F.filter(F.array_distinct(words), lambda w: w.rlike(f"^{id_}$"))
    counted = lambda w: F.regexp_like(q, F.concat(F.lit("(?<![\\p{L}\\p{N}_])"), w, F.lit("\\s*(?:puzzles?|each|个|道|题|条|more|additional)")))
    loose = F.filter(bare, lambda w: ~counted(w))
    ids = F.when(F.size(found) > 0, found).otherwise(loose)
    return F.transform(F.array_sort(F.transform(ids, lambda x: x.cast("int"))), lambda x: x.cast("string"))


def context_rules(c: Column | str) -> Column:
    """Rules that a session's description names, in order of appearance."""
    ids = F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit("(?i)Rule\\s+([0-9]{1,2})"), 1)
    return F.array_distinct(F.filter(ids, lambda x: x.cast("int").between(1, 25)))


def domain_rules(c: Column | str) -> Column:
    """Rules of the kinds that a request names, in order, without those that it rules out."""
    q = _col(c)
    none = F.array().cast(_STRINGS)
    ids = lambda numbers: F.array(*[F.lit(str(i)) for i in numbers])
    wanted = F.concat(*[F.when(has_any(q, words), ids(numbers)).otherwise(none) for words, numbers in fixed.DOMAIN_WORDS])
    unwanted = F.concat(*[F.when(has_any(q, words), ids(numbers)).otherwise(none) for words, numbers in fixed.EXCLUDE_WORDS])
    return F.filter(F.array_distinct(wanted), lambda x: ~F.array_contains(unwanted, x))


def asked_bucket(c: Column | str) -> Column:
    q = _col(c)
    out = None
    for word, bucket in fixed.DIFFICULTY_WORDS.items():
        hit = F.contains(q, F.lit(word))
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return out.otherwise("medium")


def _intent(action: Column | str, rule=None, count=None, bucket=None) -> Column:
    text = lambda x: F.lit(None).cast("string") if x is None else x
    return F.struct(
        (F.lit(action) if isinstance(action, str) else action).alias("action"), text(rule).cast("string").alias("rule_id"),
        (F.lit(None) if count is None else count).cast("int").alias("count"), text(bucket).cast("string").alias("bucket"),
    )


def simple_intents(c: Column | str, context: Column | str | None = None) -> Column:
    """Intents of one request; an empty array where nothing fits. A null request has none."""
    past = context_rules(context) if context is not None else F.array().cast(_STRINGS)

    def read(q):
        return F.struct(q.alias("q"), past.alias("past"), asked_count(q).alias("count"), domain_rules(q).alias("domain"), rule_ids(q).alias("rules"), asked_bucket(q).alias("bucket"))

    return let(F.lower(strip(_col(c))), lambda q: let(read(q), _decided))


def _decided(x: Column) -> Column:
    q, past, count, domain, rules, bucket = (x[k] for k in ("q", "past", "count", "domain", "rules", "bucket"))
    none = F.array().cast("array<struct<action:string,rule_id:string,count:int,bucket:string>>")
    near = has_any(q, fixed.LIKE_WORDS) & has_any(q, fixed.UNLIKE_WORDS)
    # A kind of rules was meant, not the rule that served to describe it.
    rules = F.when((F.size(domain) > 0) & (has_any(q, fixed.GRID_WORDS) | near), F.array().cast(_STRINGS)).otherwise(rules)
    follow = has_any(q, fixed.FOLLOW_WORDS) & (F.size(past) > 0) & (F.size(rules) == 0)
    rules = F.when(follow & has_any(q, fixed.ALL_WORDS), F.slice(past, 1, 3)).when(follow, F.slice(past, 1, 1)).otherwise(rules)
    return let(rules, lambda r: _made(q, count, domain, r, bucket, none))


def _made(q: Column, count: Column, domain: Column, rules: Column, bucket: Column, none: Column) -> Column:
    some = F.size(rules) > 0
    targets = F.when(has_any(q, fixed.EACH_WORDS), rules).otherwise(F.slice(rules, 1, 1))
    made = lambda ids, n: F.transform(ids, lambda r: _intent("GENERATE", r, n, bucket))
    generate = some & (has_any(q, fixed.GENERATE_WORDS) | count.isNotNull())
    by_domain = (F.size(domain) > 0) & (has_any(q, fixed.DOMAIN_REQUEST_WORDS) | count.isNotNull())
    out = None
    for action, words in fixed.INTENT_WORDS.items():
        one = F.array(_intent(action, count=F.coalesce(F.nullif(count, F.lit(0)), F.lit(3)) if action == "RECOMMEND" else None))
        hit = has_any(q, words)
        out = F.when(hit, one) if out is None else out.when(hit, one)
    return (
        out.when(some & has_any(q, fixed.INSPECT_WORDS), F.array(_intent("INSPECT_RULE", F.get(rules, F.lit(0)))))
        .when(generate, made(targets, F.least(F.coalesce(F.nullif(count, F.lit(0)), F.lit(1)), F.lit(20))))
        .when(by_domain, made(F.slice(domain, 1, 3), F.coalesce(F.nullif(count, F.lit(0)), F.lit(1))))
        .otherwise(none)
    )


def parts(c: Column | str) -> Column:
    """The parts of a request that joins several by connectors or commas."""
    return F.split(F.lower(strip(_col(c))), "(?:然后|接着|并且|还有|，|,)\\s*")


def normalized_intents(json: Column | str) -> Column:
    """Intents of a model's JSON answer: names of actions unified, a domain as its first three rules, five items by default."""
    kind = "struct<intents:array<struct<action:string,params:struct<rule_id:string,rules:array<string>,count:int,difficulty:string,domain:string>>>>"
    given = F.from_json(_col(json), kind)["intents"]
    names = {"LIST": "LIST_RULES", "INSPECT": "INSPECT_RULE", "GENERATE_PUZZLES": "GENERATE"}
    known = ["LIST_RULES", "INSPECT_RULE", "GENERATE", "VALIDATE", "EXPORT", "STATS", "HELP"]
    none = F.array().cast("array<struct<action:string,rule_id:string,count:int,bucket:string>>")
    domains = F.create_map(*[x for name, ids in fixed.DOMAINS.items() for x in (F.lit(name), F.array(*[F.lit(str(i)) for i in ids]))])

    def one(i):
        a = F.upper(strip(F.coalesce(i["action"], F.lit(""))))
        for old, new in names.items():
            a = F.when(a == old, new).otherwise(a)
        p = i["params"]
        rule = F.coalesce(F.nullif(p["rule_id"], F.lit("")), F.get(p["rules"], F.lit(0)))
        by_rule = F.array(_intent("GENERATE", rule, F.coalesce(p["count"], F.lit(5)), F.coalesce(p["difficulty"], F.lit("medium"))))
        by_domain = F.transform(F.slice(F.coalesce(F.try_element_at(domains, p["domain"]), F.array().cast(_STRINGS)), 1, 3), lambda r: _intent("GENERATE", r, F.lit(1), F.lit("medium")))
        made = F.when(rule.isNotNull(), by_rule).otherwise(by_domain)
        return F.when(a == "GENERATE", made).when(a == "INSPECT_RULE", F.array(_intent("INSPECT_RULE", F.coalesce(p["rule_id"], F.lit(""))))).when(a.isin(known), F.array(_intent(a))).otherwise(none)

    all_ = F.flatten(F.transform(F.coalesce(given, F.array().cast("array<struct<action:string,params:struct<rule_id:string,rules:array<string>,count:int,difficulty:string,domain:string>>>")), one))
    return F.when(F.size(all_) > 0, all_).otherwise(F.array(_intent("HELP")))


def intents_of(df, query: str, key: str, context: str | None = None):
    """(key, position, action, rule_id, count, bucket) of every request in ``df``.

    A request that joins several by connecting words is split, and the intents of its parts are taken together; it
    counts as a whole if no part has any.
    """
    whole = simple_intents(query, context)
    base = df.select(key, F.col(query).alias("_q"), (F.col(context) if context else F.lit("")).alias("_c"), whole.alias("_whole"))
    joined = F.lower(F.col("_q"))
    pieces = base.where(has_any(joined, fixed.COMPOUND_WORDS) & (F.size(parts("_q")) > 1)).select(key, "_c", F.posexplode(parts("_q")).alias("_at", "_part"))
    of_parts = pieces.select(key, "_at", F.posexplode(simple_intents("_part", "_c")).alias("_sub", "_i"))
    split = of_parts.select(key).distinct()
    simple = base.join(split, key, "left_anti").select(key, F.lit(0).alias("_at"), F.posexplode("_whole").alias("_sub", "_i"))
    return simple.unionByName(of_parts).select(key, (F.col("_at") * 1000 + F.col("_sub")).alias("position"), "_i.*")
