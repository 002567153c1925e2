"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled table of URLs (LABELLED by default); an executor
scores host and path alone, so queries and fragments never count.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.llm._shared import columns
from lumora.llm._text import plain

BLOCK, ALLOW = "block", "allow"
#: (rule, verdict): a host and a path beginning in one string; the longest rule that fits decides.
RULES = (("com/en/", BLOCK), ("example.com/en/7", ALLOW), ("net/de/", ALLOW), ("example.net/de/8", BLOCK), ("org/es/", BLOCK))
#: The small labelled table, invented hosts of kinds that crawls hold: pages to keep, and pages of gambling, adult,
#: pharmacy, counterfeit, loan, phishing, malware, tracking and link-farm sites.
_KEEP = """
https://www.cityuniversity.edu/physics/lectures/week-3.html http://library.townarchive.org/catalogue/item/48213 https://blog.gardenersdiary.net/2019/05/growing-tomatoes-from-seed https://docs.openwidget.io/reference/configuration
https://news.dailycourier.com/world/2021/03/12/election-results https://en.encyclopedia.org/wiki/Photosynthesis https://www.mountainrescue.org.uk/training/first-aid https://recipes.homekitchen.com/soup/lentil-and-carrot
https://www.nationalmuseum.gov/exhibitions/bronze-age http://math.stackforum.com/questions/77182/prove-that-the-series-converges https://www.cyclingclub.de/touren/sommer/alpen https://www.lemondedujardin.fr/conseils/taille-des-rosiers
https://www.bibliotecapublica.es/eventos/lectura-infantil https://hospital.stmary.org/departments/cardiology https://www.weatherservice.gov/forecast/coastal https://forum.modelrailways.co.uk/thread/12-gauge-track-layout
https://www.journalofgeology.org/volume/34/issue/2/abstract https://www.symphony-hall.org/season/programme https://github.codehost.com/parser/readme https://travel.slowroads.com/portugal/porto-in-three-days
https://www.chessclub.org/openings/sicilian-defence https://podcast.historyhour.com/episodes/the-roman-roads https://www.parliament.gov/bills/2020/water-act https://kids.sciencefair.org/experiments/volcano
https://www.oceanographic.edu/research/coral-reefs https://shop.woodenboats.com/plans/dinghy https://www.schoolboard.org/calendar/2022 http://www.poetrycorner.net/poems/autumn-evening https://www.bakersguild.com/bread/sourdough-starter
https://support.printerworks.com/manuals/setup-guide.pdf https://www.birdwatchers.org/sightings/april https://api.mapservice.org/docs/tiles https://www.zeitungarchiv.de/artikel/1989/mauerfall https://www.theatre-royal.com/whats-on/hamlet
https://www.citycouncil.gov/planning/applications/5521 https://www.runnersmagazine.com/training/marathon-plan https://www.astronomy-now.org/planets/saturn-rings https://wiki.linuxusers.org/index.php/Kernel_modules https://www.farmersmarket.com/stalls/cheese
https://www.charityrun.org/donate/hospice https://www.operahouse.org/history/architecture https://lists.developers.org/archives/2018-June/msg00231.html https://www.languageschool.com/courses/beginner-italian https://www.railwaytimetable.com/stations/northgate
https://www.hikingtrails.net/routes/lake-circuit https://www.filmfestival.org/jury/2017 https://www.cooperativebank.com/about/history https://www.archaeology-news.org/digs/viking-ship https://www.academic-press.com/books/linear-algebra
https://www.vetclinic.com/advice/puppy-vaccination https://www.yogastudio.com/timetable https://www.philosophypages.org/kant/critique https://www.publicradio.org/programmes/morning-concert https://www.quiltmakers.net/patterns/log-cabin
https://www.engineeringtoolkit.com/tables/steel-sections https://www.citybus.com/routes/24 https://www.kindergarten-sonne.de/aktuelles https://www.museodelprado.org/coleccion/velazquez https://www.mairie-village.fr/vie-municipale/conseil
https://photos.familytree.org/albums/1950s https://www.geography-lessons.com/rivers/meanders https://www.electronics-hobby.com/projects/radio-kit https://www.novelreaders.com/reviews/moby-dick https://www.footballhistory.org/world-cup/1966
https://www.treesurgeons.co.uk/services/pruning https://www.statisticsoffice.gov/population/census https://www.mathsteacher.com/worksheets/fractions https://www.choirmusic.org/scores/requiem https://www.localhistory.org.uk/parish/records
https://www.paediatrics.edu/guidelines/asthma https://www.botanicgarden.org/visit/opening-hours https://en.software-manual.com/chapter/installation http://www.amateurradio.org/antenna/dipole https://www.lighthouse-society.org/members/newsletter
https://www.climatedata.org/observations/rainfall https://www.carpentry-tips.com/joints/dovetail https://www.employmentlaw.gov/leave/parental https://www.sheetmusic-library.org/bach/fugue https://www.newsletter-archive.net/2003/november
""".split()  # fmt: skip
_BLOCK = """
https://www.casino-royal-bonus.com/free-spins http://best-online-casino.bet/slots/jackpot https://poker-bonus24.net/no-deposit https://sportsbetting-odds.win/live https://lucky-slots777.xyz/spin http://bet-now-win.top/promo
https://free-xxx-videos.com/watch/teen https://hot-sex-cams.live/girls http://adult-dating-tonight.com/signup https://porn-tube-hd.xxx/video/88321 https://nude-webcam-chat.net/room https://escort-girls-vip.biz/city
http://cheap-viagra-online.com/order https://buy-cialis-pills.net/no-prescription http://canadian-pharmacy-rx.biz/discount https://order-xanax-cheap.top/buy https://weight-loss-pills-fast.info/buy-now https://steroids-shop24.com/cart
http://replica-watches-sale.com/rolex https://cheap-designer-handbags.shop/outlet http://fake-id-cards.cc/order https://replica-sneakers-outlet.top/discount http://luxury-replica-bags.ru/sale https://counterfeit-notes.cc/buy
https://payday-loans-instant.com/apply http://fast-cash-advance.biz/no-credit-check https://quick-loan-approved.xyz/apply-now https://bad-credit-loans24.info/instant http://easy-money-loans.top/cash https://debt-relief-now.click/offer
https://secure-login-paypa1.com/verify/account http://account-update-bank.tk/signin.php https://apple-id-verify.cf/login http://webmail-password-reset.ga/confirm.php https://banking-security-alert.ml/update http://wallet-verify-login.xyz/seed-phrase
http://free-crack-download.ru/keygen.exe https://full-version-crack.net/serial-key http://download-codec-player.info/setup.exe https://free-antivirus-scan.click/alert.exe http://warez-torrent-cracked.to/keygen https://flash-update-now.pw/install.exe
https://click-track-ads.com/redirect?aff=99 http://ad-server-banner.net/popunder.js https://pixel-tracker24.com/collect http://popup-ads-network.biz/serve https://affiliate-click-redirect.top/go https://adclick-tracking.click/r/881
http://buy-backlinks-cheap.com/seo-links https://link-farm-directory.info/add-url http://seo-spam-links.top/page1 https://article-spinner-links.xyz/a/1 http://free-traffic-exchange.biz/hits https://cheap-seo-backlinks.click/order
https://crypto-doubler-btc.com/invest http://bitcoin-profit-robot.xyz/signup https://double-your-crypto.top/deposit http://forex-millionaire-secret.info/join https://get-rich-quick24.biz/offer http://free-bitcoin-giveaway.live/claim
https://win-free-iphone.click/claim-prize http://you-are-winner-prize.xyz/claim https://gift-card-generator.top/free http://survey-reward-prize.win/spin https://free-gift-cards24.live/claim http://lottery-winner-claim.tk/prize
https://vegas-casino-games.info/play http://winbig-casino.net/bonus https://blackjack-roulette-win.com/table http://bingo-bonus-cash.top/join https://free-bet-tips.info/odds https://casino-affiliates-win.biz/ref
https://adult-chat-rooms.net/enter http://sexy-singles-nearby.com/meet https://xxx-adult-movies.top/clips http://milf-porn-tube.net/videos https://online-pills-store.com/checkout http://generic-pills-rx.info/cheap
https://ad-tracker-click.net/imp http://track-ads-pixel.info/px http://spam-mailer-tools.com/bulk https://spam-links-farm.net/directory http://link-exchange-farm.biz/submit https://cheap-loans-online.info/approve
http://replica-shop-cheap.net/sale https://keygen-crack-serial.com/full http://malware-free-scanner.top/scan.exe https://verify-your-account-login.info/secure http://crypto-profit-signals.biz/vip https://win-cash-prizes-now.com/enter
""".split()  # fmt: skip


def _variants(url: str, n: int) -> list[str]:
    """A url with and without ``www.``, and in another of the common domains: neither says much of a page."""
    host, slash, path = url.split("://")[1].removeprefix("www.").partition("/")
    other = f"{host.rpartition('.')[0]}.{('com', 'org', 'net')[n % 3]}"
    return [f"https://{h}{slash}{path}" for h in (host, f"www.{host}", other)]


LABELLED = tuple((v, y) for urls, y in ((_KEEP, 0), (_BLOCK, 1)) for n, u in enumerate(urls) for v in _variants(u, n))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    rest = rest[:end]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    low: int = 4
    high: int = 6

    def grams(self, host: str, path: str) -> np.ndarray:
        """Buckets of the distinct n-grams of host and path; both have ends marked."""
        out = set()
        for mark, part in ((b"h", host), (b"p", path.lower())):
            data = b"^" + part.encode("utf-8", "replace") + b"$"
            for n in range(self.low, self.high + 1):
                for i in range(len(data) - n + 1):
                    out.add(zlib.crc32(mark + data[i : i + n]) % len(self.weights))
        return np.fromiter(out, np.int64, len(out))

    def score(self, host: str, path: str) -> float:
        g = self.grams(host, path)
        z = self.bias + (self.weights[g].sum() / np.sqrt(len(g)) if len(g) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(labelled=LABELLED, buckets: int = 1 << 18, rounds: int = 3000, rate: float = 2.0, ridge: float = 1e-4, prior: float = 0.25) -> Model:
    """Full-batch gradient descent from zero: the same table gives the same model. The table must fit the driver.

    The constant term is fixed: a url without any known n-gram is to be blocked with the chance ``prior``. Learnt
    from a table, it would say how the table was made.
    """
    rows = sorted((*split_url(u), int(y)) for u, y in labelled)
    b = float(np.log(prior / (1 - prior)))
    model = Model(np.zeros(buckets), b)
    if not rows:
        return model
    grams = [model.grams(h, p) for h, p, _ in rows]
    y = np.array([r[2] for r in rows], float)
    owner = np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    flat = np.concatenate(grams)
    scale = (1 / np.sqrt(np.maximum(1, [len(g) for g in grams])))[owner]
    used, at = np.unique(flat, return_inverse=True)
    w = np.zeros(len(used))
    for _ in range(rounds):
        z = b + np.bincount(owner, w[at] * scale, len(rows))
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        w -= rate * (np.bincount(at, g[owner] * scale, len(used)) + ridge * w)
    model.weights[used] = w
    return model


def _scores(model: Model, limit: float):
    def run(batches):
        for batch in batches:
            known: dict[tuple[str, str], float] = {}
            out = []
            for host, path in zip(plain(batch.column(1)).to_pylist(), plain(batch.column(2)).to_pylist(), strict=True):
                if (host, path) not in known:
                    known[host, path] = model.score(host, path)
                out.append(known[host, path])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "score"])
    return run


def url_verdicts(pages: DataFrame, rules=RULES, model: Model | None = None, limit: float = 0.5) -> DataFrame:
    """Per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, score (block likelier towards 1).

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest that fits
    decides, and among equally long ones the first by code point. Without a rule the model's score does:
    block from ``limit``. A null or empty url, or one without ``://``, has an empty host and path. Urls of any
    length are judged whole; repeated rows are judged each, alike; a null page_id stays null. Other columns are
    not read. An empty table gives no rows.
    """
    model = model or train()
    rows = columns(pages, "page_id", "url")
    rest = F.regexp_extract("url", r"^(?s).*?://([^?#]*)", 1)
    rest = F.when(F.col("url").contains("://"), rest).otherwise("")
    rows = rows.withColumn("rest", rest).withColumn("host", F.translate(F.substring_index("rest", "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    rows = rows.withColumn("path", F.expr("substring(rest, length(substring_index(rest, '/', 1)) + 1)")).select("page_id", "host", "path")
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.mapInArrow(_scores(model, limit), f"page_id {kind}, host string, path string, score double")
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(slash + path)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    learnt = F.when(F.col("score") >= limit, BLOCK).otherwise(ALLOW)
    return rows.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learnt).alias("verdict"), "score")
