"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = rf"""
with items as (select row_number() over () item, cast(item_id as varchar) item_id, {_WORDS} w from benchmark),
windows as (
  select item, item_id, i j, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') win, least(10, len(w)) n
  from (select item, item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) i from items where len(w) > 0)),
docs as (select row_number() over () rid, doc_id, {_WORDS} w from documents),
lengths as (select distinct n from windows),
spots as (select rid, i, n, array_to_string(w[i : i + n - 1], ' ') win
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from docs, lengths where len(w) >= n)),
hits as (select s.rid, s.i, s.n, v.item_id, v.item, v.j from spots s join windows v on s.win = v.win and s.n = v.n),
words as (select rid, count(*) n_hit from (select distinct rid, unnest(range(i, i + n)) p from hits) group by rid),
found as (select rid, count(*) n_items, string_agg(item_id, ',' order by item_id) ids from (select distinct rid, item_id from hits) group by rid),
matches as (select rid, count(*) n_matches, max(m) longest_match from (select rid, count(*) + min(n) - 1 m
  from (select *, i - row_number() over (partition by rid, item, i - j order by i) island from hits) group by rid, item, i - j, island) group by rid)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated, coalesce(n_matches, 0) n_matches, coalesce(longest_match, 0) longest_match
from docs left join words using (rid) left join found using (rid) left join matches using (rid)
"""

SQL: dict[str, str] = {"op1_decontamination": OP1}


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _licence_sql() -> str:
    from lodestat.llm import licenses as lic

    known = ", ".join(f"{_quote(k)}: {_quote(v)}" for k, v in lic.KNOWN.items())
    anchor = "(?i)" + "|".join("[^A-Za-z0-9]+".join(a.split()) for a in lic.ANCHORS)
    wrapped = r"regexp_replace(regexp_replace(t, '\n[\x20\x09\x0D]*\n', '. ' || chr(10), 'g'), '([^.!?;\n])[\x20\x09\x0D]*\n', '\1 ', 'g')"
    words = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    for pattern, form in lic.SAME:
        words = f"regexp_replace({words}, '{pattern}', '{form}')"
    joined = r"regexp_replace({{}}, '\b([vV])\.[\x20\x09-\x0D]+([0-9])', '\1 \2', 'g')"
    ids = rf"""list_transform(list_filter(list_transform(string_split(regexp_replace({joined.format()}, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
      lambda s: {words}), lambda s: not regexp_matches(s, '^(?:[0-9 ]*|[a-z])$')), lambda s: coalesce(names[s], '-'))"""
    rules = ", ".join(f"{{'l': '', 'f': cast([] as varchar[]), 'p': {_quote(',' + ','.join(row) + ',')}, 'n': {_quote(name)}}}" for name, _, row in lic.RULES)
    start = "{{'l': ',' || array_to_string({0}, ',') || ',', 'f': cast([] as varchar[]), 'p': '', 'n': ''}}"
    step = "{'l': replace(s.l, r.p, ',#,'), 'f': case when contains(s.l, r.p) then list_append(s.f, r.n) else s.f end, 'p': '', 'n': ''}"
    found = lambda side: f"case when len(list_filter({side}, lambda s: s != '-')) > 0 then list_reduce(list_prepend({start.format(side)}, rules), lambda s, r: {step}).f else [] end"
    kinds = " ".join(f"when list_has_any(l, [{', '.join(_quote(n) for n in sorted({n for n, kk, _ in lic.RULES if kk == k}))}]) then '{k}'" for k in lic.KINDS)
    return rf"""
with k as (select map {{{known}}} as names, [{rules}] as rules),
d as (select row_number() over () rid, doc_id, case when regexp_matches(text, {_quote(anchor)}) then text end t from documents),
i as (select rid, doc_id, {ids.format("t")} a, {ids.format(wrapped)} b from d, k),
o as (select doc_id, case when a is null then [] else list_sort(list_distinct(list_concat({found("a")}, {found("b")}))) end l,
  list_filter(a, lambda s: s != '-') ka, list_filter(b, lambda s: s != '-') kb from i, k),
p as (select doc_id, l, coalesce(case when len(kb) > len(ka) then kb else ka end, []) k from o)
select doc_id, array_to_string(l, ',') licences, array_to_string(k, ',') sentences, cast(len(k) as bigint) n_sentences, case {kinds} else 'none' end kind from p
"""


def _url_sql() -> str:
    from lodestat.llm import urls

    rules = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in urls.HOST_RULES)
    words, paths = "|".join(urls.BLOCKED_WORDS), "|".join(urls.BLOCKED_PATHS)
    return rf"""
with rules(action, h, p) as (values {rules}),
u as (select row_number() over () rid, page_id, {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
best as (select rid, arg_max(h || p, (length(h || p), h || p)) rule, arg_max(action, (length(h || p), h || p)) action
  from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by rid)
select page_id, host, path, rule,
  coalesce(action, case when regexp_matches(host, '(?s)(^|[.-])({words})([^a-z0-9]|$)') or regexp_matches(path, '(?is)^/(.*[^a-z0-9])?({paths})([^a-z0-9]|$)')
    or regexp_matches(host, '(?s)^{urls.NUMERIC_HOST}(:|$)') then 'block' else 'allow' end) verdict
from u left join best using (rid)
"""


_KEY = "cast('0x' || substr(md5({}), 1, 15) as bigint)"
_CRC = r"""xor(4294967295, list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
  lambda x: cast('0x' || x as bigint))), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)))"""

OP6 = rf"""
with recursive t as (select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) tab),
d as (select row_number() over () rid, doc_id, cast(octet_length(encode(coalesce(text, ''))) + 16 as bigint) size, {_CRC} text_crc32,
  {_KEY.format("coalesce(cast(doc_id as varchar), '')")} k from documents, t),
j(rid, n, k, b, nxt) as (
  select rid, n, cast(k as hugeint), cast(-1 as bigint), cast(0 as bigint) from d, (values (40), (41)) s(n)
  union all
  select rid, n, k2, nxt, cast(floor((nxt + 1) * (2147483648::double / cast((k2 // 8589934592) + 1 as double))) as bigint)
  from (select rid, n, nxt, (k * 2862933555777941757 + 1) % 18446744073709551616 k2 from j where nxt < n)),
s as (select rid, n, max(b) shard from j group by rid, n)
select doc_id, size, text_crc32, 'key' law, cast(a.shard as integer) shard,
  row_number() over (partition by a.shard order by place, doc_id, text_crc32, size) - 1 slot, cast(g.shard as integer) grown_shard
from (select *, {_KEY.format("coalesce(cast(doc_id as varchar), '') || '|' || text_crc32 || '|' || size")} place from d) d
join s a on a.rid = d.rid and a.n = 40 join s g on g.rid = d.rid and g.n = 41
"""

OP8 = rf"""
with recursive d as (select row_number() over () rid, doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) tokens from documents),
s as (select source, sum(tokens)::bigint tokens from d group by source),
p as (select list(tokens / total::double) shares, count(*) n, max(tokens) most, min(tokens) least, max(total) total
  from (select source, tokens, sum(tokens) over () total from s where tokens > 0)),
even(m, lo, hi, ok) as (
  select null::bigint, 0::bigint, 1048576::bigint, null::boolean
  union all
  select mid, case when uneven then lo else mid + 1 end, case when uneven then mid else hi end, uneven
  from (select lo, hi, (lo + hi) // 2 mid,
    ln(list_sum(list_transform(shares, lambda x: pow(x, ((lo + hi) // 2) / 1048576.0))))
    - ((lo + hi) // 2) / 1048576.0 * list_sum(list_transform(shares, lambda x: pow(x, ((lo + hi) // 2) / 1048576.0) * ln(x)))
      / list_sum(list_transform(shares, lambda x: pow(x, ((lo + hi) // 2) / 1048576.0))) < 0.998 * ln(n) - 1e-9 uneven
    from even, p where lo < hi)),
floors(lo, hi) as (
  select 0::bigint, 1048576::bigint
  union all
  select case when ok then lo else (lo + hi) // 2 + 1 end, case when ok then (lo + hi) // 2 else hi end
  from (select lo, hi, pow(most / least::double, 1 - ((lo + hi) // 2) / 1048576.0) <= 2.0 ok from floors, p where lo < hi)),
chosen as (select case when n < 2 then 1.0::double else greatest(
    case when ln(list_sum(shares)) - list_sum(list_transform(shares, lambda x: x * ln(x))) / list_sum(shares) < 0.998 * ln(n) - 1e-9
      then greatest(0, (select max(lo) from even where lo >= hi) - 1) else 1048576 end,
    (select max(lo) from floors where lo >= hi)) / 1048576.0::double end e from p),
plan as (select source, tokens,
    case when tokens > 0 then round(pow(tokens / total::double, e) / (select list_sum(list_transform(shares, lambda x: pow(x, e))) from p, chosen), 9) else 0 end weight,
    case when tokens > 0 then round(pow(most / tokens::double, 1 - e), 9) else 1 end passes
  from s, p, chosen),
w as (select *, cast(floor(passes) as bigint) whole, floor((passes - floor(passes)) * tokens) rest from plan),
k as (select d.rid, d.doc_id, d.source, d.tokens, w.weight, w.whole, w.rest,
    {_KEY.format("coalesce(cast(doc_id as varchar), '') || '|' || cast(whole as varchar)")} key from d join w on d.source is not distinct from w.source),
sums as (select source, key, sum(sum(tokens)) over (partition by source order by key) upto from k group by source, key),
cuts as (select sums.source, max(key) cut from sums join w on sums.source is not distinct from w.source where upto <= rest and rest > 0 group by sums.source),
taken as (select k.*, whole + case when key <= coalesce(cut, -1) then 1 else 0 end n from k left join cuts on k.source is not distinct from cuts.source)
select doc_id, source, tokens, weight, cast(block as integer) block, {_KEY.format("coalesce(cast(doc_id as varchar), '') || '|' || cast(block as varchar)")} block_key
from (select *, unnest(range(0, n)) block from taken)
"""

OP9 = r"""
with d as (select row_number() over () rid, doc_id, length(coalesce(text, '')) n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) h from documents),
r as (select *, row_number() over (partition by h order by n desc, doc_id nulls last, rid) place, first_value(doc_id) over (partition by h order by n desc, doc_id nulls last, rid) keep_id,
  count(*) over (partition by h) group_size from d)
select doc_id, keep_id, group_size, place = 1 kept, h text_sha256 from r
"""


def _pii_sql() -> str:
    from lodestat.llm import pii

    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[ -]?[0-9])+",
        "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    }
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when (length({digits}) - i) % 2 = 1
      then 2 * cast(substr({digits}, i, 1) as int) - case when cast(substr({digits}, i, 1) as int) > 4 then 9 else 0 end else cast(substr({digits}, i, 1) as int) end)) % 10 = 0"""
    good = {
        "email": "true",
        "ip": "len(list_filter(string_split(v, '.'), lambda p: cast(p as hugeint) > 255)) = 0",
        "card": f"length({digits}) between 13 and 19 and {luhn}",
        "phone": f"length({digits}) between 9 and 15",
    }

    def matches(kind: str, pattern: str, source: str, text: str) -> str:
        return f"""select rid, '{kind}' kind, b, b + length(v) e, v from (select rid, m[i] v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) b
      from (select rid, string_split_regex({text}, '{pattern}') g, regexp_extract_all({text}, '{pattern}') m from {source}), unnest(range(1, len(m) + 1)) u(i))"""

    base = " union all ".join(f"select {n} o, * from ({matches(k, p, 'd', 't')}) where {good[k]}" for n, (k, p) in enumerate(patterns.items()))
    kinds = (*patterns, *pii.ADDED)
    term = matches("", pii.TERM, "(select rid, " + _LOWER.format("blank") + " l from blanked)", "l")
    counts = ", ".join(f"cast(count(*) filter (kind = '{k}') as bigint) n_{k}" for k in kinds)
    # Spans of a row in order, each less what those before it cover, are put in place of the text between.
    clipped = """select rid, list({'at': e, 'b': greatest(b, was), 'w': w, 'out': ''} order by b, e desc, o) l from (
      select *, coalesce(max(e) over (partition by rid order by b, e desc, o rows between unbounded preceding and 1 preceding), 0) was from %s) where e > was group by rid"""
    rewritten = """(list_reduce(list_prepend({'at': 0, 'b': 0, 'w': '', 'out': ''}, l), lambda s, x: {'at': x.at, 'b': x.b, 'w': '', 'out': s.out || substr(t, s.at + 1, x.b - s.at) || x.w}).out
      || substr(t, l[len(l)].at + 1))"""
    word = "case kind when 'remove' then '' when 'generalise' then '[TERM]' else '[' || upper(kind) || ']' end"
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
base as materialized (select cast(o as int) o, rid, kind, cast(b as int) b, cast(e as int) e, v from ({base})),
blanked as materialized (select rid, coalesce({rewritten}, t) blank from d left join
  ({clipped % "(select *, repeat(' ', e - greatest(b, coalesce(max(e) over (partition by rid order by b, e desc, o rows between unbounded preceding and 1 preceding), 0))) w from base)"}) using (rid)),
held as (select distinct rid, kind || ':' || case kind when 'email' then {_LOWER.format("v")} when 'ip' then v else {digits} end en from base),
entities as (select en, count(*) n from held group by en having count(*) >= {pii.SUPPORT}),
words as materialized ({term}),
own as (select distinct rid, v from words where rid in (select rid from held)),
pairs as (select en, v, count(*) c from own join held using (rid) join entities using (en) group by en, v having count(*) >= {pii.SUPPORT}),
df as (select v, count(*) m from (select rid, unnest(list_distinct(regexp_extract_all({_LOWER.format("t")}, '{pii.TERM}'))) v from d) group by v),
total as (select count(*)::double n from d),
told as (select v, max(ln(least(c, m) * total.n / (m * entities.n)) / ln(total.n / entities.n)) told from pairs join entities using (en) join df using (v), total where entities.n < total.n group by v),
terms as (select case when told >= {pii.REMOVE} then 5 else 4 end o, rid, case when told >= {pii.REMOVE} then 'remove' else 'generalise' end kind, cast(b as int) b, cast(e as int) e, v
  from words join told using (v) where told >= {pii.GENERALISE}),
spans as (select * from base union all select * from terms),
texts as (select rid, coalesce({rewritten}, t) sanitised from d left join ({clipped % f"(select *, {word} w from spans)"}) using (rid)),
agg as (select rid, {counts}, string_agg(kind || ':' || b || ':' || e, ',' order by o, b) filter (o < 4) base, string_agg(kind || ':' || b || ':' || e, ',' order by o, b) spans from spans group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0) n_{k}" for k in kinds)}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, sha256(sanitised) sanitised_sha256
from d left join agg using (rid) left join texts using (rid)
"""


SQL |= {"op3_licenses": _licence_sql(), "op4_urls": _url_sql(), "op6_sharding": OP6, "op7_pii": _pii_sql(), "op8_mixing": OP8, "op9_exact_dedup": OP9}


def _secret_sql() -> str:
    from lodestat.llm import secrets

    kinds = " union all ".join(
        f"""select {n} o, rid, '{r.kind}' kind, b, b + length(v) e from (select rid, m[i] v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) b
      from (select rid, string_split_regex(t, {_quote(r.pattern)}) g, regexp_extract_all(t, {_quote(r.pattern)}) m from d where regexp_matches(t, {_quote(r.hint.replace("(?=[PpSsTtAa])", ""))})), unnest(range(1, len(m) + 1)) u(i))
      where length(regexp_extract(v, {_quote(r.pattern)}, {r.group})) >= {r.least}"""
        for n, r in enumerate(secrets.RULES)
    )
    base = ", ".join(_quote(r.kind) for r in secrets.BASE)
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}')::bigint n_{r.kind}" for r in secrets.RULES)
    shown = ", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in secrets.RULES)
    return rf"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
s as (select o, rid, kind, cast(b as int) b, cast(e as int) e from ({kinds})),
agg as (select rid, {counts}, string_agg(kind || ':' || b || ':' || e, ',' order by b, o) filter (kind in ({base})) base, string_agg(kind || ':' || b || ':' || e, ',' order by b, o) spans from s group by rid)
select doc_id, {shown}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans, sha256(t) blob from d left join agg using (rid)
"""


OP12 = rf"""
with docs as (select row_number() over () rid, coalesce(lang, 'und') lang, {_LOWER.format("coalesce(text, '')")} t from documents),
pieces as (select lang, regexp_extract_all(unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') w from docs),
grams as (select lang, k, array_to_string(w[i : i + k - 1], ' ') phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from pieces, (values (1), (2), (3), (4)) s(k) where len(w) >= k)),
f as materialized (select lang, k, phrase, count(*) f from grams group by all),
totals as (select lang, sum(f)::bigint n from f where k = 1 group by lang),
c as (select lang, k, phrase, f a, string_split(phrase, ' ') w from f where k > 1 and f >= 30),
inner_ as (select lang, a, array_to_string(w[i : i + m - 1], ' ') phrase from (select *, unnest(range(1, k - m + 2)) i from (select *, unnest(range(2, k)) m from c where k > 2))),
kept as (select c.* from c left join (select lang, phrase, max(a) longer from inner_ group by all) x on c.lang = x.lang and c.phrase = x.phrase
  where longer is null or 100 * longer::hugeint < 80 * a::hugeint),
cuts as (select lang, phrase, a, cut, array_to_string(w[1 : cut], ' ') head, array_to_string(w[cut + 1 : k], ' ') rest from (select *, unnest(range(1, k)) cut from kept)),
scored as (select cuts.*, x.f l, y.f r, (2000000::hugeint * a // (x.f::hugeint + y.f))::bigint score
  from cuts join f x on cuts.lang = x.lang and cuts.head = x.phrase join f y on cuts.lang = y.lang and cuts.rest = y.phrase),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, rank, phrase, a, l, r, n, score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from lowest) join totals using (lang) where rank <= 2000
"""

SQL |= {"op11_secrets": _secret_sql(), "op12_phrases": OP12}

OP13 = rf"""
with docs as (select row_number() over () rid, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') t from documents),
wanted as materialized (select distinct item_id, unnest(regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) term from benchmark),
totals as (select count(*)::bigint n_docs, sum(len(t))::bigint n_terms from docs where len(t) > 0),
tf as materialized (select rid, term, count(*)::bigint tf from (select rid, unnest(t) term from docs) semi join wanted using (term) group by rid, term),
weights as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint w from (select term, count(*) df from tf group by term), totals),
sizes as (select rid, doc_id, 100 - 90 + (90 * len(t)::bigint * n_docs) // n_terms m from docs, totals where len(t) > 0),
scores as (select item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::bigint score
  from wanted join tf using (term) join weights using (term) join sizes using (rid) group by all having score > 0)
select item_id, rank::int rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id nulls last) rank from scores) where rank <= 10
"""

SQL |= {"op13_search": OP13}
