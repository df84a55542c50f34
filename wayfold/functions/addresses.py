"""Addresses, links and visitors as the catalogue keeps them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions that have a page of their own, by how addresses start.
REGIONS = ("서울", "경기", "부산", "인천", "대구", "대전", "광주", "울산", "제주")
#: Long names of provinces and cities, and their short ones.
PROVINCES = {
    "서울특별시": "서울", "부산광역시": "부산", "대구광역시": "대구", "인천광역시": "인천", "광주광역시": "광주", "대전광역시": "대전", "울산광역시": "울산",
    "세종특별자치시": "세종", "제주특별자치도": "제주", "경기도": "경기", "강원특별자치도": "강원", "강원도": "강원", "충청북도": "충북", "충청남도": "충남",
    "전라북도": "전북", "전북특별자치도": "전북", "전라남도": "전남", "경상북도": "경북", "경상남도": "경남",
}
#: Sources whose pages are read from another host.
MOBILE = {"naver_blog": ("blog.naver.com", "m.blog.naver.com"), "naver_cafe": ("cafe.naver.com", "m.cafe.naver.com")}


def region_of(address: Column) -> Column:
    """The region that an address starts with; null if none."""
    start = F.ltrim(address)
    return F.coalesce(*[F.when(F.startswith(start, F.lit(r)), F.lit(r)) for r in REGIONS])


def normalized(address: Column) -> Column:
    """An address for comparison: short names of provinces, nothing in parentheses, no spaces."""
    short = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), PROVINCES.items(), address)
    return F.regexp_replace(F.regexp_replace(short, r"\s*\([^)]*\)\s*", ""), r"\s+", "")


def mobile_url(url: Column, source: Column) -> Column:
    """The link to the mobile page, for sources that have one; others as they are."""
    out = url
    for name, (host, mobile) in MOBILE.items():
        out = F.when(source == name, F.regexp_replace(url, rf"^(https?://){host.replace('.', chr(92) + '.')}([/?#:].*)?$", f"$1{mobile}$2")).otherwise(out)
    return out


def video_id(url: Column) -> Column:
    """The id of a video link; null if it has none."""
    return F.nullif(F.regexp_extract(url, r"(?:[?&]v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})", 1), F.lit(""))


def thumbnail(video: Column) -> Column:
    return F.concat(F.lit("https://img.youtube.com/vi/"), video, F.lit("/mqdefault.jpg"))


def visitor(ip: Column) -> Column:
    """What is kept of an address of a visitor."""
    return F.sha2(ip, 256)


def same_day(a: Column, b: Column) -> Column:
    """Whether two times are of one day; never true of nulls."""
    return F.coalesce(F.to_date(a) == F.to_date(b), F.lit(False))
