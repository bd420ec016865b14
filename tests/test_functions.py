"""Literals of the scalar functions."""

import json
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from marlstone.functions import classify, codes, hashing, json_rows, masking, money, text


def run(spark, f, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(args))]).alias("x")).first().x


@pytest.mark.parametrize("x,want", [("包1", "1"), ("包01", "1"), ("包一", "1"), ("分包1", "1"), ("分包编号1", "1"), ("标包1", "1"), ("第十二包", "12"), ("二十包", "20"), ("包000", "0"), ("甲", "甲"), (None, "")])
def test_package_no(spark, x, want):
    assert run(spark, codes.normalize_package_no, x) == want


@pytest.mark.parametrize(
    "x,context,want",
    [("86万元", None, 860000), ("1,234,567.89元", None, D("1234567.89")), ("86.5万", None, 865000), ("人民币86万元", None, 860000), ("65.88", "成交金额（万元）", 658800), ("97.50%", None, None), ("费率 1.5%", None, None), ("评分 88.00 分", None, None), ("none", None, None)],
)
def test_money(spark, x, context, want):
    assert run(spark, money.parse_money, x, context) == want


def test_header_unit_wins(spark):
    f = lambda v, h, c: money.parse_money(v, money.unit_context(h, c))
    assert run(spark, f, "65.88", "成交金额（元）", "单位：万元") == D("65.88") and run(spark, f, "65.88", "成交金额", "单位：万元") == 658800


@pytest.mark.parametrize("x,kind,want", [("折扣率90%", "DiscountRate", "0.9"), ("下浮率10%", "ReductionRate", "0.1"), ("报价系数0.92", "Coefficient", "0.92"), ("9折", "DiscountRate", "0.9"), ("比例90%", "Unknown", "0.9")])
def test_rates(spark, x, kind, want):
    got = run(spark, money.parse_rate, x)
    assert (got.rate_type, got.rate_value) == (kind, D(want))


def test_no_rate(spark):
    assert run(spark, money.parse_rate, "12") is None and run(spark, money.parse_fold, "八五") == D("0.85") and run(spark, money.parse_fold, "9") == D("0.9")


def test_amount_kinds(spark):
    kinds = {"成交金额：65.88万元": "DealAmount", "预算金额 150 万元": "BudgetAmount", "投标保证金：5000元": "Deposit", "折扣率：八五折": "DiscountRate", "中标价 3": "WinningPrice", "x": "Unknown"}
    for x, want in kinds.items():
        assert run(spark, money.classify_amount, x) == want
    status = lambda k, v: money.amount_status(k, v)["status"]
    assert run(spark, status, "DealAmount", "1") == "Recommended" and run(spark, status, "Deposit", "1") == "Rejected" and run(spark, status, "Rate", "1") == "Unresolved"
    got = run(spark, money.normalize_money, "1.5", "亿", "")
    assert (got.unit, got.amount) == ("亿元", 150_000_000)
    assert run(spark, lambda x: money.plain_number(x.cast("decimal(18,6)")), "900000.500000") == "900000.5"


def test_text(spark):
    assert run(spark, text.clean_value, "  a&amp;b　 c ") == "a&b c" and run(spark, text.clean_value, "n/a") == "" and run(spark, text.clean_value, "??12") == "" and run(spark, text.clean_value, None) == ""
    assert run(spark, text.is_blank, " \u3000\t") and not run(spark, text.is_blank, "x") and run(spark, text.is_missing, "-")
    assert run(spark, text.similarity, "ab c", "ABC") == 1.0 and run(spark, text.similarity, "abcd", "bc") == 0.88 and run(spark, text.similarity, "abxy", "abz") == 0.5 and run(spark, text.similarity, "", "a") == 0
    assert run(spark, text.keywords, "ab, c，def ab") == ["ab", "def"] and run(spark, lambda x: text.source_line(x, F.lit(4)), "a\nb\nc") == 3
    assert run(spark, text.html_to_text, "<p>a<script>x</script>&amp; b</p>") == "a & b" and run(spark, text.comparable, "a: b，c") == "ABC"


def test_codes(spark):
    assert run(spark, codes.extract_project_code, "项目编号：AB12CD-001") == "AB12CD" and run(spark, codes.extract_project_code, "招标编号: xyz_99") == "XYZ_99" and run(spark, codes.extract_project_code, "none") == ""
    assert run(spark, codes.clean_org_name, "第一中标候选人：某某电力有限公司 等") == "某某电力有限公司" and run(spark, codes.org_match_key, "1、某某(北京)有限公司") == "某某北京有限公司"
    assert run(spark, codes.supplier_compatible, "北京某某电力设备有限公司", "某某电力设备有限公司") and not run(spark, codes.supplier_compatible, "甲公司", "乙公司")
    assert run(spark, codes.parse_rank, "第二名") == 2 and run(spark, codes.parse_rank, "7") == 7 and run(spark, codes.parse_rank, "x") is None
    assert run(spark, codes.extract_lot_name, "分标名称：变电设备。后") == "变电设备" and run(spark, codes.business_code, "（a b）1", "h") == "(AB)1" and run(spark, codes.business_code, " ", "h") == "url:h"


def test_masks(spark):
    kinds = [("13812345678", "phone", "138****5678"), ("zhangsan@example.com", "email", "z***@example.com"), ("192.168.1.10", "ip", "192.168.1.*"), ("abc", "token", "***REDACTED***"), ("Ada", "name", "A**"), ("12 Long Street", "address", "12 ******eet"), ("", "phone", "")]
    for x, kind, want in kinds:
        assert run(spark, lambda c, kind=kind: masking.mask(c, kind), x) == want
    assert run(spark, masking.mask_text, "a@b.co 13812345678 11010519491231002X token: abc") == "a***@b.co 138****5678 110105********002X token:***REDACTED***"


def test_hashes(spark):
    assert run(spark, hashing.content_hash, " a \n b ") == run(spark, hashing.content_hash, "a b")
    assert run(spark, hashing.url_hash, "HTTP://X.com/A/?q=B#C") == run(spark, lambda x: F.sha2(x, 256), "http://x.com/a?q=B#C")
    assert run(spark, hashing.source_hash, " a", None) == run(spark, lambda x: F.sha2(x, 256), "a\u001f")


def test_rules(spark):
    process = lambda x: classify.notice_process(x)["process"]
    assert run(spark, process, "某公开招标公告") == "OpenBidding" and run(spark, process, "询价公告") == "NonBidding" and run(spark, process, "x") == "Unknown"
    assert run(spark, classify.is_non_award, "包1流标") and not run(spark, classify.is_non_award, "某某有限公司")
    assert run(spark, lambda n: classify.backoff_seconds(n.cast("int"), 30, 100), "3") == 100.0
    assert run(spark, lambda s: classify.stage_progress(s, {"won": 100}, 5), "won") == 100 and run(spark, lambda s: classify.normalized_choice(s, ["Keep"], "Drop"), " keep") == "Keep"


def _plain_mask(value):
    if isinstance(value, dict):
        return {k: masking.MASK if any(s in k.lower().replace("-", "") for s in masking.SENSITIVE_KEYS) else _plain_mask(v) for k, v in value.items()}
    return [_plain_mask(v) for v in value] if isinstance(value, list) else value


def _plain_find(value, name):
    own = value.items() if isinstance(value, dict) else []
    for k, v in own:
        if k.lower() == name and v is not None and not isinstance(v, (dict, list)):
            return v if isinstance(v, str) else json.dumps(v)
    for v in value.values() if isinstance(value, dict) else value if isinstance(value, list) else []:
        if (got := _plain_find(v, name)) is not None:
            return got
    return None


def _plain_clean(value):
    if isinstance(value, dict):
        return {k: _plain_clean(v) for k, v in sorted(value.items()) if k.lower() not in json_rows.IDENTITY}
    return [_plain_clean(v) for v in value] if isinstance(value, list) else value


def _any_json(rng, depth=0):
    if depth > 4 or rng.random() < 0.4:
        return rng.choice([None, True, 3, -2.5, "x", "a,b", 'q"{}', "é\\", ""])
    if rng.random() < 0.5:
        return [_any_json(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {k: _any_json(rng, depth + 1) for k in rng.sample(["kind", "Password", "Api-Key", "tenantId", "UserId", "b", "n:x", "KIND2"], rng.randint(0, 5))}


def test_json_as_rows_against_plain_python(spark):
    rng = random.Random(8)
    docs = [_any_json(rng) for _ in range(250)]
    texts = [json.dumps(d, ensure_ascii=False, indent=rng.choice([None, 2])) for d in docs] + ["no json", None, "{", '{"token":1,"token":{"a":2}}']
    df = spark.createDataFrame(list(enumerate(texts)), "k int, j string")
    got = {r["k"]: r["j"] for r in json_rows.masked(df, "k", "j").collect()}
    assert all(json.loads(got[k]) == _plain_mask(d) for k, d in enumerate(docs))
    assert [got[k] for k in range(250, 254)] == ["no json", None, "{", '{"token": "***REDACTED***", "token": "***REDACTED***"}']
    names = ["kind", "B", "n:x"]
    seen = {r["k"]: [r[n] for n in names] for r in json_rows.found(df, "k", "j", names).collect()}
    assert len(seen) == len(texts) and all(seen[k] == [_plain_find(d, n.lower()) for n in names] for k, d in enumerate(docs))
    left = {r["k"]: r["c"] for r in json_rows.canonical(df, "k", "j", "c").collect()}
    assert all(json.loads(left[k]) == _plain_clean(d) for k, d in enumerate(docs) if d is not None)
    assert left[250] is None and left[251] is None
    same = spark.createDataFrame([(1, '{"n":3, "userId":5}'), (2, '{"tenant_id":{"x":[1]},"n":3}')], "k int, j string")
    assert len({r["f"] for r in json_rows.fingerprints(same, "k", "j", "f").collect()}) == 1
