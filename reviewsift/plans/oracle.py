"""SQL counterparts of the views and shared fragments for the correctness queries."""

from __future__ import annotations

from collections.abc import Sequence

from reviewsift.lexicon import Lexicon, PatternSet, V2_EMPTY_FLAGS, V2_INFORMATIVE_FLAGS


def rnd(expr: str, digits: int) -> str:
    scale = f"{10**digits}.0::double"
    return f"(round_even(cast({expr} as double) * {scale}, 0) / {scale})"


def pct(expr: str) -> str:
    return rnd(f"({expr}) * 100", 2)


def big(expr: str) -> str:
    return f"cast({expr} as bigint)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, '[^\\s]+'))"


def collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^\\s+', ''), '\\s+$', '')"


def any_of(text: str, terms: Sequence[str]) -> str:
    return "(" + " or ".join(f"contains({text}, {lit(t)})" for t in terms) + ")"


def hits(text: str, terms: Sequence[str]) -> str:
    values = ", ".join(lit(t) for t in terms)
    return f"list_filter([{values}], lambda t: contains({text}, t))"


def flag_list(*pairs: tuple[str, str]) -> str:
    """Names of the conditions that hold."""
    values = ", ".join(f"case when {cond} then '{name}' end" for name, cond in pairs)
    return f"list_filter([{values}], lambda f: f is not null)"


PADDED = "case when length(doc_id::varchar) < 5 then lpad(doc_id::varchar, 5, '0') else doc_id::varchar end"

REVIEWS = f"""
base as (
  select d.doc_id, d.text, d.lang, d.source, e.user_id as uid, e.event_type, e.ts, e.value,
         cast(json_extract_string(e.props, '$.k') as integer) as k,
         string_split(d.text, ' ') as w
  from documents d join events e on e.event_id = d.doc_id
),
reviews as (
  select doc_id, doc_id::varchar as review_id,
    'MANUAL_' || ({PADDED}) as annotation_id,
    source as product_id, uid::varchar as user_id, '' as product_name, lang as category,
    case when event_type = 'error' and k < 50 then null else cast(1 + k % 5 as integer) end as rating,
    case when event_type = 'signup' then '' else array_to_string(w[1:3], ' ') end as title,
    case when event_type = 'signup' then text else coalesce(array_to_string(w[4:], ' '), '') end as content,
    ts + to_days(k * 9) as created_at, ts as crawled_at,
    cast(floor(value / 10) as integer) as helpful_count,
    event_type = 'purchase' as purchased,
    'group_' || lang as sample_group,
    case when event_type = 'view' then 'uncertain' when event_type <> 'signup'
         then case when value >= 20 then '1' else '0' end end as manual_label,
    source || '.csv' as source_file
  from base
),
rows_ as (
  select *, trim({strip('title')} || '. ' || {strip('content')}, '. ') as review_text,
    cast(coalesce(purchased, false) as integer) as purchased_int
  from reviews
),
review_rows as (
  select *, cast({words('review_text')} as integer) as word_count from rows_
)"""

LABELS = f"""
labels0 as (
  select 'MANUAL_' || ({PADDED}) as annotation_id, cast(quality as integer) as is_helpful,
    cast(doc_id % 3 as integer) as specificity,
    cast((doc_id // 3) % 3 as integer) as product_experience,
    cast((doc_id // 9) % 3 as integer) as decision_value,
    cast(doc_id % 2 as integer) as clarity,
    cast(-((doc_id // 7) % 3) as integer) as noise_penalty,
    0.5::double + cast(doc_id % 50 as double) / 100 as confidence,
    'because' as reason,
    {flag_list(('ambiguous', 'doc_id % 11 = 0'), ('contains_comparison', 'doc_id % 4 = 0'),
               ('contains_product_defect', 'doc_id % 7 = 0'), ('generic_only', 'doc_id % 5 = 0'),
               ('possible_fake_or_spam', 'doc_id % 13 = 0'))} as quality_flags,
    'v1' as label_version,
    case when toxic = 1 then 'llm' else 'codex_rule_adjudicated' end as label_source,
    toxic = 0 as adjudicated
  from labels
),
label_rows as (
  select *, specificity + product_experience + decision_value + clarity + noise_penalty
      as helpfulness_score,
    confidence < 0.7 or list_contains(quality_flags, 'ambiguous')
      or list_contains(quality_flags, 'possible_fake_or_spam') as needs_human_review
  from labels0
)"""

CHECKPOINT = """
checkpoint as (
  select *, 0 as batch_seq from label_rows
  union all
  select * replace (1.0::double as confidence), 1 as batch_seq from label_rows
  where label_source = 'llm'
)"""

GOLD = """
gold as (
  select r.*, l.* exclude (annotation_id), l.is_helpful as help
  from review_rows r join label_rows l on r.annotation_id = l.annotation_id
),
gold_all as (
  select r.*, l.* exclude (annotation_id, quality_flags),
    coalesce(l.quality_flags, []::varchar[]) as quality_flags,
    r.manual_label as original_manual_label,
    coalesce(r.manual_label in ('0', '1') and r.manual_label = l.is_helpful::varchar, false)
      as agrees_with_original
  from review_rows r left join label_rows l on r.annotation_id = l.annotation_id
)"""

EDA = f"""
eda0 as (
  select * exclude (helpful_count), review_text as review_context,
    coalesce(cast(helpful_count as double), 0.0::double) as helpful_count
  from gold
),
eda as (
  select *, cast(length(review_context) as integer) as review_char_length,
    word_count as review_word_length,
    cast(length({strip('title')}) as integer) as title_char_length,
    cast(length({strip('content')}) as integer) as content_char_length,
    cast(greatest(1, len(regexp_extract_all(review_context, '[.!?]+'))) as integer) as sentence_count,
    cast(length(review_context) - length(replace(review_context, '!', '')) as integer) as exclamation_count,
    cast(length(review_context) - length(replace(review_context, '?', '')) as integer) as question_count,
    cast(length(review_context) - length(regexp_replace(review_context, '[0-9]', '', 'g')) as integer) as digit_count,
    cast(year(created_at) as integer) as created_year,
    cast(month(created_at) as integer) as created_month,
    cast(hour(created_at) as integer) as created_hour,
    dayname(created_at) as created_weekday,
    cast(helpful_count > 0 as integer) as has_helpful_vote
  from eda0
)"""

PREDICTIONS = """
predictions as (
  select r.doc_id, r.annotation_id, r.review_id, r.product_id, r.category as model,
    r.doc_id as original_index,
    cast(r.doc_id * 7919 % 200 as double) / 200 as helpfulness_score,
    cast(r.doc_id * 7919 % 200 as double) / 200 as proba_helpful,
    l.is_helpful as label,
    cast(cast(r.doc_id * 7919 % 200 as double) / 200 >= 0.5 as integer) as pred,
    cast(r.doc_id % 3 as integer) as fold
  from review_rows r left join label_rows l on r.annotation_id = l.annotation_id
)"""

REQUESTS = """
requests as (
  select doc_id, annotation_id, case when title = '' then '' else product_id end as product_name,
    category, rating, content as review_text, cast(helpful_count - 1 as double) as price,
    title as brand, doc_id as original_index
  from review_rows
)"""

PARTS = {
    "reviews": REVIEWS,
    "labels": LABELS,
    "checkpoint": CHECKPOINT,
    "gold": GOLD,
    "eda": EDA,
    "predictions": PREDICTIONS,
    "requests": REQUESTS,
}


def sql(parts: str, body: str) -> str:
    """A query with the named view fragments in front."""
    chosen = [PARTS[p] for p in parts.split()]
    if not chosen:
        return body.strip()
    extra = body.strip()
    joined = ",".join(c.strip() for c in chosen)
    if extra.startswith(","):
        return f"with {joined}{extra}"
    return f"with {joined}\n{extra}"


def rate_sql(
    by: str,
    source: str = "gold",
    label: str = "help",
    means: Sequence[tuple[str, str, int]] = (),
    share: bool = False,
    keep_null: bool = False,
    extra: str = "",
) -> str:
    cols = [
        by,
        f"{big('count(*)')} as review_count",
        f"{big(f'sum({label})')} as helpful_count",
        f"{pct(f'avg({label})')} as helpful_rate",
    ]
    exact = "sum(cast({0} as decimal(38,10)))::double / count({0})"
    cols += [f"{rnd(exact.format(c), d)} as {out}" for out, c, d in means]
    if share:
        cols.append(
            f"{rnd(f'count(*)::double / (select count(*) from {source}) * 100', 2)} as percentage"
        )
    if extra:
        cols.append(extra)
    where = "" if keep_null else f" where {by} is not null"
    return f"select {', '.join(cols)} from {source}{where} group by {by}"


def buckets_sql(
    column: str,
    case: str,
    labels: Sequence[str],
    source: str = "gold",
    label: str = "help",
    means: Sequence[tuple[str, str, int]] = (),
    share: bool = False,
) -> str:
    """A bucket report with empty buckets kept, as the tail of a query."""
    values = ", ".join(f"({i}, {lit(name)})" for i, name in enumerate(labels))
    inner = rate_sql(column, f"(select *, {case} as {column} from {source})", label, means)
    outs = [f"r.{out}" for out, _, _ in means]
    if share:
        outs.append(
            f"coalesce({rnd(f'r.review_count::double / (select count(*) from {source}) * 100', 2)}, 0.0) as percentage"
        )
    columns = ", ".join(
        [
            "b.bucket_order", f"b.{column}",
            "coalesce(r.review_count, 0) as review_count",
            "coalesce(r.helpful_count, 0) as helpful_count", "r.helpful_rate", *outs,
        ]
    )
    return (
        f"select {columns} from (values {values}) b(bucket_order, {column}) "
        f"left join ({inner}) r on r.{column} = b.{column}"
    )


def case_buckets(expr: str, edges, labels, right: bool = True) -> str:
    """A CASE for intervals; None leaves an end open."""
    whens = []
    for low, high, name in zip(edges[:-1], edges[1:], labels):
        tests = [f"{expr} is not null"]
        if low is not None:
            tests.append(f"{expr} {'>' if right else '>='} {low}")
        if high is not None:
            tests.append(f"{expr} {'<=' if right else '<'} {high}")
        whens.append(f"when {' and '.join(tests)} then {lit(name)}")
    return f"case {' '.join(whens)} end"


def number_regex(units: Sequence[str]) -> str:
    """Whether a word-bounded number occurs; RE2 has no Unicode word boundary, so the
    neighbours are spelled out. Non-letter units never change whether a match exists."""
    letters = [u for u in units if u.isalpha()]
    inside = r"\p{L}\p{N}_"
    return rf"(^|[^{inside}])[0-9]+({'|'.join(letters)})?($|[^{inside}])"


def rubric_sql(lex: Lexicon, body: str, source: str = "reviews", human: bool = True) -> str:
    """The first rubric as SQL; ``body`` selects from `refined`."""
    original = "coalesce(manual_label, 'nan')" if human else "'uncertain'"
    generic = "|".join(lex.generic_words)
    phrases = ", ".join(lit(p) for p in lex.generic_phrases)
    return f""",
r0 as (
  select annotation_id, {original} as human,
    {collapse("nfc_normalize(coalesce(title, ''))")} as title_,
    {collapse("nfc_normalize(coalesce(content, ''))")} as content_
  from {source}
),
r1 as (
  select *, lower(content_) as c, lower(trim(title_ || '. ' || content_, '. ')) as t,
    {collapse("regexp_replace(lower(content_), '[^\\p{L}\\p{N}_À-ỹ\\s]', ' ', 'g')")} as plain
  from r0
),
r2 as (
  select *, {hits('c', lex.attributes)} as attrs, {hits('c', lex.decision)} as decs,
    {hits('c', lex.defects)} as defs, {any_of('c', lex.experience)} as exper,
    {any_of('c', lex.shipping)} as ship,
    regexp_matches(c, {lit(number_regex(lex.number_units))}) as num,
    len(regexp_extract_all(c, '[\\p{{L}}\\p{{N}}_]+')) as nw,
    not regexp_matches(c, '[\\p{{L}}\\p{{N}}]') as noise,
    plain in ({phrases}) or regexp_matches(plain, '^({generic})( ({generic})){{0,4}}$') as generic,
    {any_of('c', lex.spam)} as spam
  from r1
),
r3 as (
  select *, ship and len(attrs) + len(decs) + len(defs) = 0 and not exper as ship_only from r2
),
r4 as (
  select *,
    case when noise then 0 when generic and nw <= 3 then 0
      when (num or len(attrs) >= 2 or len(decs) >= 2 or (len(defs) > 0 and nw >= 4))
           and not (generic or ship_only) then 2
      when len(attrs) > 0 or num or len(decs) > 0 or len(defs) > 0 then 1 else 0 end as specificity,
    case when noise or generic or ship_only or not exper then 0
      when num or len(attrs) > 0 or nw >= 20 then 2 else 1 end as product_experience,
    case when noise or generic or ship_only then 0
      when len(attrs) >= 2 or len(decs) > 0 or len(defs) > 0 or (len(attrs) > 0 and num) then 2
      when len(attrs) > 0 then 1 else 0 end as decision_value,
    case when noise or nw < 1 then 0 else 1 end as clarity,
    case when noise then -2 when spam and len(attrs) = 0 then -1 else 0 end as noise_penalty
  from r3
),
r5 as (
  select *, specificity + product_experience + decision_value + clarity + noise_penalty as score
  from r4
),
r6 as (
  select *, case when score >= 4 then 1 when score <= 1 then 0
      when len(attrs) + len(decs) + len(defs) > 0 or num then 1
      when human in ('0', '1') then cast(human as integer) else 0 end as label
  from r5
),
r7 as (
  select *, case when score between 2 and 3 then case when human = 'uncertain' then 0.62::double else 0.68::double end
      when score in (1, 4) then 0.82::double else 0.92::double end as base,
    human in ('0', '1') as binary_, human = label::varchar as agrees
  from r6
),
r8 as (
  select *, {rnd("case when binary_ and agrees then least(0.96::double, base + 0.04::double) "
                 "when binary_ then least(0.72::double, base) else base end", 3)} as confidence,
    {flag_list(
        ('ambiguous', 'score between 2 and 3 or (binary_ and not agrees)'),
        ('noise_text', 'noise'), ('generic_only', 'generic'), ('shipping_only', 'ship_only'),
        ('seller_service_only', any_of('c', lex.seller) + ' and len(attrs) = 0'),
        ('too_short_but_specific', 'nw <= 5 and len(attrs) > 0 and not generic'),
        ('contains_product_defect', 'len(defs) > 0'),
        ('contains_usage_context', '(exper or num)'),
        ('contains_comparison', any_of('c', lex.comparison)),
        ('contains_size_fit_info', any_of('c', lex.size_fit)),
        ('contains_durability_info', any_of('c', lex.durability)),
        ('contains_packaging_info', any_of('c', lex.packaging)))} as flags0
  from r7
),
r9 as (
  select *, {refine_list('flags0', 't', 'label', lex)} as flags from r8
),
refined as (
  select annotation_id, label as is_helpful, score as helpfulness_score, confidence,
    specificity, product_experience, decision_value, clarity, noise_penalty,
    array_to_string(flags, ',') as flags,
    confidence < 0.7 or list_contains(flags, 'ambiguous')
      or list_contains(flags, 'possible_fake_or_spam') as needs_human_review
  from r9
)
{body}"""


def refine_list(flags: str, text: str, label: str, lex: Lexicon) -> str:
    kept = (
        f"list_filter({flags}, lambda f: not ((f = 'too_short_but_specific' and {label} = 0) or "
        f"(f = 'generic_only' and {label} = 1) or "
        f"(f = 'contains_product_defect' and not {any_of(text, lex.refine_defects)}) or "
        f"(f = 'contains_durability_info' and not {any_of(text, lex.refine_durability)})))"
    )
    extra = (
        f"case when {any_of(text, lex.refine_comparison)} then ['contains_comparison'] "
        f"else []::varchar[] end"
    )
    return f"list_sort(list_distinct(list_concat({kept}, {extra})))"


def re2(pattern: str) -> str:
    r"""A pattern for RE2: `\b` at the end of a term means no letter, digit or `_` follows."""
    return lit(pattern.replace(r"\b", r"($|[^\p{L}\p{N}_])"))


def rubric_v2_sql(p: PatternSet, source: str = "review_rows") -> str:
    """The second rubric as SQL."""

    def hit(pattern: str, text: str = "low") -> str:
        return f"regexp_matches({text}, {re2(pattern)})"

    def count(patterns: Sequence[str]) -> str:
        return " + ".join(f"cast({hit(x)} as integer)" for x in patterns)

    flags = dict(p.flags)
    spam = " or ".join(hit(x, "lows") for x in p.spam)
    repeated = "len(list_filter(list_distinct(string_split(t, '')), lambda ch: ch <> chr(10) and contains(t, repeat(ch, {n})))) > 0"
    ship_only = f"({hit(flags['shipping'])} and not {hit(flags['product'])} and specificity = 0)"
    named = []
    for name, pattern in flags.items():
        if name in ("shipping", "product", "seller"):
            continue
        extra = " and specificity >= 1" if name == "contains_usage_context" else ""
        named.append((name, hit(pattern) + extra))
    informative = "[" + ", ".join(lit(f) for f in V2_INFORMATIVE_FLAGS) + "]"
    empty = "[" + ", ".join(lit(f) for f in V2_EMPTY_FLAGS) + "]"
    return f""",
v0 as (
  select annotation_id, word_count as wc,
    case when length(review_text) > 0 then review_text when length(content) > 0 then content else '' end as t
  from {source}
),
v1 as (select *, lower(t) as low, {strip('lower(t)')} as lows, {words('t')} as nw,
         string_split_regex({strip('lower(t)')}, '\\s+') as ws from v0),
v2 as (
  select *, {count(p.specific_strong)} as st, {count(p.specific_medium)} as me,
    {count(p.experience)} as used, {count(p.decision_strong)} as ds, {count(p.decision_medium)} as dm
  from v1
),
v3 as (
  select *, case when st >= 2 or (st >= 1 and me >= 1) then 2 when st + me >= 1 then 1 else 0 end as specificity,
    case when {hit(p.not_used_yet)} then 0 else least(used, 2) end as product_experience
  from v2
),
v4 as (
  select *, case when ds >= 2 or (ds >= 1 and specificity >= 2) then 2
      when ds >= 1 or dm >= 2 or (specificity >= 1 and product_experience >= 1) then 1 else 0 end as decision_value,
    case when nw <= 2 or {repeated.format(n=6)} or not regexp_matches(t, '[\\p{{L}}\\p{{N}}_]') then 0 else 1 end as clarity,
    greatest(-2, case when regexp_matches(lows, '^[.…\\s!?*]+$') then -2
      when {repeated.format(n=7)} then -1 else 0 end - cast({spam} as integer)) as noise_penalty
  from v3
),
v5 as (
  select *, specificity + product_experience + decision_value + clarity + noise_penalty as score,
    len(ws) as n, ws[1:len(ws) // 2] as first_half, list_distinct(ws[len(ws) // 2 + 1:]) as second_half
  from v4
),
v6 as (
  select *, list_sort({flag_list(
      ('generic_only', 'specificity + product_experience + decision_value = 0'),
      ('too_short_but_specific', 'wc <= 5 and specificity >= 1'),
      ('noise_text', 'noise_penalty <= -1'),
      ('shipping_only', ship_only),
      ('seller_service_only', f"{hit(flags['seller'])} and not {hit(flags['product'])} and specificity = 0 and not {ship_only}"),
      *named,
      ('duplicate_like', 'n > 12 and len(list_filter(first_half, lambda x: list_contains(second_half, x))) > n // 3'),
      ('ambiguous', 'score between 2 and 3'))}) as flags
  from v5
),
v7 as (
  select *, case when score >= 3 then 1 when score <= 1 then 0
      when list_has_any(flags, {informative}) then 1 when list_has_any(flags, {empty}) then 0 else 1 end as label,
    case when score between 2 and 3 then 0.65::double when score >= 6 or score <= 0 then 0.95::double else 0.9::double end
      - case when wc <= 5 and not list_contains(flags, 'too_short_but_specific') then 0.05::double else 0.0::double end as conf
  from v6
)
select annotation_id, label as is_helpful, score as helpfulness_score,
  {rnd('greatest(0.5::double, least(conf, 0.99::double))', 2)} as confidence,
  specificity, product_experience, decision_value, clarity, noise_penalty,
  array_to_string(flags, ',') as flags
from v7"""


def reason_sql(text: str, lex: Lexicon) -> str:
    low = f"lower({text})"
    features = " + ".join(f"cast(contains({low}, {lit(w)}) as integer)" for w in lex.feature_words)
    codes = flag_list(
        ("specific_experience", f"regexp_matches({low}, {lit(number_regex(lex.quantity_units))})"),
        ("mentions_product_features", f"{features} >= 2"),
        ("mentions_pros_and_cons", f"{any_of(low, lex.pros)} and {any_of(low, lex.cons)}"),
        ("sufficient_detail", f"{words(text)} >= 25"),
    )
    return (
        f"case when len({codes}) = 0 and {words(text)} <= 8 then ['too_generic'] else {codes} end"
    )
