"""What a URL says before anything is fetched: its kind, its labels, whether it may be an article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions import urls
from leafmill.functions.text import col, let, null_if_empty

# Hosts that never hold a readable article.
NON_ARTICLE_HOSTS = (
    "youtube.com youtu.be twitter.com x.com facebook.com instagram.com tiktok.com pinterest.com "
    "reddit.com linkedin.com amazon.com ebay.com spotify.com podcasts.apple.com apple.com "
    "indeed.com glassdoor.com monster.com ziprecruiter.com simplyhired.com careerbuilder.com "
    "greenhouse.io lever.co ashbyhq.com myworkdayjobs.com smartrecruiters.com workable.com "
    "francetravail.fr hellowork.com"
).split()
# Sub-domains kept for job ads.
JOB_SUBDOMAINS = "jobs careers career emplois recrutement".split()
# Whole path segments of listings, shops, forums and account pages.
NON_ARTICLE_SEGMENTS = (
    "shop store product products cart checkout basket collection collections pricing buy order orders "
    "category categories tag tags author wishlist forum forums viewtopic showthread thread threads "
    "comments login signin signup register account search contact privacy terms job jobs career careers "
    "emplois offres-emploi stellenangebote vacancies openings"
).split()
# Extensions of downloads.
FILE_EXTENSIONS = (
    "pdf ps djvu doc docx odt rtf pages txt md xls xlsx ods csv numbers ppt pptx odp key zip rar 7z gz "
    "tar tgz dmg exe msi apk epub mobi azw azw3 mp3 m4a wav ogg flac mp4 m4v mov avi mkv webm png jpg "
    "jpeg gif webp svg tif tiff bmp heic xml json"
).split()
# Query keys of on-site searches and listings.
LISTING_KEYS = "q s search query".split()
# Parts of a same-site path that is never an article.
EXCLUDED_PATHS = "/about /contact /newsletter /privacy /terms /rss /feed /tag/ /category/ /author/ /page/ /search".split()
# Extensions of same-site files.
SITE_FILES = "pdf png jpg jpeg gif svg zip tar gz mp3 mp4 wav".split()
# Extensions of audio files.
AUDIO_EXTENSIONS = "mp3 m4a aac ogg opus wav".split()
# Sub-domains that hold reference works, whose home is one page.
REFERENCE_SUBDOMAINS = "doc docs book developer developers learn api".split()
# Tabs of a channel page.
CHANNEL_TABS = "videos streams shorts featured".split()
# The addresses of a video, with the shape of its id, and of a channel.
CHANNEL = r"youtube\.com/(@|channel/|c/|user/)"
VIDEO_ID = r"(?:[?&]v=|youtu\.be/|youtube\.com/(?:shorts|live|embed)/)([A-Za-z0-9_-]{6,})"


def any_of(words) -> str:
    return "(" + "|".join(w.replace(".", r"\.") for w in words) + ")"


HOSTS_PATTERN = rf"(^|\.){any_of(NON_ARTICLE_HOSTS)}$"
JOBS_PATTERN = rf"^{any_of(JOB_SUBDOMAINS)}\."
LISTING_PATTERN = rf"(?i)(^|&){any_of(LISTING_KEYS)}=[^&]"


def url_kind(url: Column | str) -> Column:
    url = col(url)
    low = F.lower(url)
    watch = low.contains("youtube.com/watch") & low.contains("v=")
    return (
        F.when(watch | url.rlike(VIDEO_ID), "youtube_video")
        .when(low.contains("list=") | low.contains("youtube.com/playlist"), "youtube_playlist")
        .when(low.rlike(CHANNEL), "youtube_channel")
        .when(urls.path(low).rlike(rf"\.{any_of(AUDIO_EXTENSIONS)}$"), "podcast")
        .otherwise("blog")
    )


def kinds_by_host(links: DataFrame) -> DataFrame:
    return links.groupBy(urls.host("url").alias("host"), url_kind("url").alias("kind")).agg(F.count("*").alias("links"))


def video_id(url: Column | str) -> Column:
    url = col(url)
    last = F.regexp_extract(F.regexp_replace(url, "/+$", ""), r"([^/]*)$", 1)
    return F.coalesce(null_if_empty(F.regexp_extract(url, VIDEO_ID, 1)), last)


def watch_url(video: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video)


def is_article_like(url: Column | str) -> Column:
    """Neither a known non-article host, nor a listing, shop, account or job page, nor a file."""
    site = urls.host(url)
    parts = F.transform(urls.segments(url), lambda s: F.lower(s))
    last = F.coalesce(F.element_at(parts, F.when(F.size(parts) > 0, -1)), F.lit(""))
    listed = F.arrays_overlap(parts, F.array(*[F.lit(s) for s in NON_ARTICLE_SEGMENTS]))
    return ~(
        site.rlike(HOSTS_PATTERN)
        | site.rlike(JOBS_PATTERN)
        | F.coalesce(listed, F.lit(False))
        | urls.extension(last).isin(*FILE_EXTENSIONS)
        | urls.query_string(url).rlike(LISTING_PATTERN)
    )


def looks_like_article(href: Column | str, base_url: Column | str) -> Column:
    """A same-site link whose path has the shape of an article."""
    path = F.lower(urls.path(href))
    netloc = urls.netloc(href)
    slug = F.regexp_extract(F.regexp_replace(path, "/+$", ""), r"([^/]*)$", 1)
    rejected = (
        ((netloc != "") & (netloc != urls.netloc(base_url)))
        | urls.unquote(path).contains(":")
        | path.rlike(rf"\.{any_of(SITE_FILES)}$")
        | path.rlike(any_of(EXCLUDED_PATHS))
    )
    slashes = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    accepted = (
        path.rlike(r"^/\d{4}/")
        | path.rlike("/(post|posts|article|articles)/")
        | (path.contains("/blog/") & (slashes >= 3))
        | ((F.length(slug) >= 8) & slug.contains("-"))
    )
    return ~rejected & accepted


# IPv4 networks that are not public (private, loopback, link-local, reserved, multicast).
CLOSED_NETWORKS = (
    "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 "
    "192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/4 240.0.0.0/4"
).split()
# Addresses inside them that are public.
OPEN_ADDRESSES = "192.0.0.9 192.0.0.10".split()
IPV4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def _number(address: str) -> int:
    a, b, c, d = (int(x) for x in address.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def network_bounds(network: str) -> tuple[int, int]:
    base, bits = network.split("/")
    return _number(base), _number(base) + 2 ** (32 - int(bits)) - 1


def _public_v4(address: Column) -> Column:
    number = F.aggregate(
        F.split(address, r"\."), F.lit(0).cast("bigint"), lambda n, octet: n * 256 + F.coalesce(octet.try_cast("bigint"), F.lit(0))
    )

    def judged(n: Column) -> Column:
        closed = F.lit(False)
        for network in CLOSED_NETWORKS:
            closed = closed | n.between(*network_bounds(network))
        return ~closed | n.isin(*[_number(a) for a in OPEN_ADDRESSES])

    return let(number, judged)


def is_public(url: Column | str) -> Column:
    """An http(s) URL with a host that is not a closed IP literal. Names are not resolved."""
    url = col(url)
    authority = F.regexp_replace(F.lower(urls.netloc(url)), r"^[^@]*@", "")
    v6 = F.regexp_extract(authority, r"^\[([0-9a-f:.]+)\]", 1)
    name = F.when(v6 != "", v6).otherwise(F.regexp_replace(authority, r":\d*$", ""))
    v4 = F.regexp_replace(name, r"^::ffff:(?=\d+\.)", "")
    open_v6 = v6.rlike("^[23][0-9a-f]{3}:") & ~v6.rlike("^(2001:(0?0?[01]?[0-9a-f]{1,2}:|:|0?db8:)|2002:|3fff:0?[0-9a-f]{0,3}:)")
    judged = let(v4, lambda a: F.when(a.rlike(IPV4), _public_v4(a)).when(v6 != "", open_v6).otherwise(True))
    return url.rlike("(?i)^https?:") & (name != "") & judged


def wiki_title(url: Column | str) -> Column:
    """The article title of an encyclopedia page, null for any other URL."""
    title = F.regexp_extract(urls.path(url), "^/wiki/([^:]+)$", 1)
    on_wiki = urls.host(url).endswith(".wikipedia.org") & (title != "")
    return F.when(on_wiki, F.replace(urls.unquote(title), F.lit("_"), F.lit(" ")))


def wiki_host(url: Column | str) -> Column:
    return F.replace(urls.host(url), F.lit(".m.wikipedia.org"), F.lit(".wikipedia.org"))


def is_site_home(url: Column | str) -> Column:
    labels = F.split(urls.host(url), r"\.")
    reference = (F.size(labels) > 2) & F.get(labels, F.lit(0)).isin(*REFERENCE_SUBDOMAINS)
    return col(url).rlike("(?i)^[a-z][a-z0-9+.-]*://") & urls.is_home(url) & ~reference


def medium(kind: Column) -> Column:
    return F.when(kind.startswith("youtube"), "video").when(kind == "podcast", "audio").otherwise("text")


def is_collection(kind: Column, url: Column | str) -> Column:
    return kind.isin("youtube_playlist", "youtube_channel") | ((kind == "blog") & is_site_home(url))


def pretty_url(url: Column | str) -> Column:
    url = col(url)
    site = urls.host(url)
    video = (site == "youtu.be") | (site.endswith("youtube.com") & (urls.path(url) == "/watch"))
    label = F.concat(site, F.regexp_replace(urls.path(url), "/+$", ""))
    return F.when(video, "YouTube video").when(site == "", url).otherwise(label)


def source_name(name: Column | str, title: Column | str, url: Column | str) -> Column:
    return F.coalesce(null_if_empty(F.trim(col(name))), null_if_empty(F.trim(col(title))), pretty_url(url))


def channel_videos_url(url: Column | str) -> Column:
    base = F.regexp_replace(F.regexp_extract(col(url), r"^([^?]*)", 1), "/+$", "")
    base = F.regexp_replace(base, f"/{any_of(CHANNEL_TABS)}$", "")
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/videos"))
