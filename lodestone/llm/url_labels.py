"""The small labelled table of the URL filter: public host names and typical paths, written down by hand.

Blocked are gambling, adult, drug, loan and pirate sites, click farms and advertisement or tracking hosts; kept are hosts of
all other kinds, among them many that share letters with blocked ones. Each host stands with a few of the paths of its kind."""

from __future__ import annotations

BLOCKED_HOSTS = """
22bet.com bet365.com betway.com betfair.com betonline.ag 888casino.com 888poker.com partypoker.com fulltiltpoker.com pokerdom.ru
leovegas.com casumo.com mrgreen-casino.se casinoeuro.com vulkanvegas.com vegas-slots.net jackpotcity.com slotomania.com megaslot.net
online-casino.de casino-royal.at bestcasinos.co.uk casino-win.net casinobonus24.org lucky-casino.io bitcasino.io roobet.com roulette77.com
roulette-system.net blackjack-online.biz bingo-jackpot.co.uk sportsbetting.ag sport-wetten.net sportwetten24.de parimatch.com 1win.pro mostbet.com
pokertracker-stars.com texas-holdem-poker.org melbet.org linebet.com megapari.com betwinner.com betsson.com bet-at-home.com bwin.com unibet.eu tipico-bet.de free-bets.co.uk freebets.net
pornhub.com redtube.com youporn.com xhamster.com xnxx.tv tube8.com spankbang.net xxxvideos.org sexcams.live adult-dating.biz adultfinder.net
livejasmin-cams.com hot-girls-cams.net sexshop.pl escort-service.nl porn-tube.org freeporn.sexy adult-x.net xxx-movies.to nude-pics.org milf-videos.xxx
buy-viagra-online.com viagra-kaufen.de cialis-generic.net cheap-pills.org cheappharmacy.biz pharma-discount.su pills-online.ru kamagra-shop.de
levitra-express.com viagra-apotek.no cialis-apotheke.at xanax-without-prescription.com tramadol-order.net dietpills24.com phentermine-online.com steroids-shop.to
payday-loans.co.uk fast-cash-loan.net quick-loans-online.biz bad-credit-loans.org earn-money-fast.biz free-money-now.com get-rich-crypto.top
double-your-bitcoin.cc forex-signals-vip.top binary-options-robot.com replica-watches.cn fake-rolex-shop.ru cheap-handbags-outlet.top
warez-bb.org cracked-software.net keygen-crack.ru torrent-movies.to free-movies-123.to putlocker-hd.ws crackserials.net nulled-scripts.to
spam-farm.com seo-backlinks.top buy-backlinks.net link-farm.info article-spinner.biz buy-followers.io cheap-likes.net content-farm.xyz
doubleclick.net adserver.adtech.de ads.yieldmo.com adnxs.com ads-track.net adtracker.io adservice.media popads.net popunder.biz clickbank-ads.com
clicktracker.biz pixel-ads.net banner-exchange.info trafficjunky.net exoclick.com propellerads.com taboola-ads.net adsrvr.org adcolony-ads.io
malware-download.ru free-virus-scan.top paypal-verify-login.tk secure-bank-login.ml account-update-verify.cf phishing-kit.top
""".split()
BLOCKED_PATHS = ["/", "/en/12345", "/de/881.html", "/fr/777/", "/index.html", "/promo/welcome-bonus?aff=22"]
BLOCKED_URLS = """
https://games.example.org/casino/play https://www.example.com/casino https://play.example.net/online-casino/bonus https://example.com/live-casino/roulette
https://example.org/poker/rooms https://cdn.example.com/slots/free-spins https://example.net/betting/odds https://media.example.com/xxx/video/1
https://example.org/porn/clips https://example.net/sex-cams/live https://shop.example.com/buy-viagra-online https://example.org/pharmacy/cheap-pills
https://example.com/ads/click?id=3 https://img.example.org/adserver/banner.js https://example.net/payday-loans/apply https://files.example.com/keygen/crack.zip
""".split()
KEPT_HOSTS = """
wikipedia.org wikimedia.org archive.org gutenberg.org loc.gov nasa.gov noaa.gov nih.gov who.int un.org europa.eu bundestag.de service-public.fr
bbc.co.uk theguardian.com lemonde.fr spiegel.de elpais.com nytimes.com reuters.com apnews.com npr.org zeit.de nature.com sciencemag.org arxiv.org
plos.org jstor.org mit.edu stanford.edu ox.ac.uk cam.ac.uk ethz.ch uni-heidelberg.de sorbonne-universite.fr uam.es python.org debian.org kernel.org
apache.org gnu.org mozilla.org github.com gitlab.com stackoverflow.com rust-lang.org golang.org postgresql.org sqlite.org w3.org ietf.org
news.example.com blog.example.org wiki.example.net docs.example.com library.example.org museum.example.net school.example.com college.example.org
research.example.net science.example.com garden.example.org kitchen.example.net recipes.example.com travel.example.org weather.example.net
sports.example.com football.example.org tennis.example.net running.example.com swimming.example.org music.example.net film.example.com cinema.example.org
books.example.net bookstore.example.com market.example.org health.example.net clinic.example.com hospital.example.org pharmacology.example.net
bank.example.com savings.example.org insurance.example.net mortgage.example.com student-loans.edu city.example.org townhall.example.net river.example.com
mountain.example.org history.example.net art.example.com gallery.example.org design.example.net code.example.com data.example.org cloud.example.net
track.example.com trackandfield.org racetrack.example.net soundtrack.example.com tracker.debian.org parcel-track.example.org trackmaps.net trackday.co.uk
adoption.example.org address.example.com adventure.example.net admissions.example.edu administration.gouv.fr advanced-materials.org adhesives.example.com
adlershof.de addis-times.example.org adsorption.example.net adult-education.org adultlearning.example.com alphabet.example.org betterhomes.example.com
between-the-lines.org betahealth.example.net bethlehem.example.org elisabeth.example.de tibet.example.org abetone.example.it diabetes.example.org
casing.example.com casino-history-museum.example.org occasion.example.fr cassini.example.edu pokemon.example.net sleepover.example.com powerpoint.example.org
pillow.example.com spill-response.example.gov caterpillar.example.com pillars.example.org freedom.example.org freeway.example.com freeware.example.net
winter.example.org windows-repair.example.com essex.example.uk sussex.ac.uk middlesex.example.uk sextant.example.org sexton.example.com saxophone.example.net
moneyhistory.example.org cashew-recipes.example.com paydayhistory.example.org analysis.example.com analytics.example.edu clickandcollect.example.com
farmhouse.example.org dairyfarm.example.net windfarm.example.com linkedlists.example.edu spamalot-musical.example.com hamspam.example.org
popular-science.example.com popcorn.example.org popover.example.net population.example.gov bannerman.example.edu trafficlights.example.org slotcars.example.com
cheapflights.example.com cheap-eats.example.org bonusfeatures.example.com jackpine.example.org crackers.example.com biscuits-and-crackers.example.org
lucky-clover.example.com loanword.example.org videolan.org videos.example.edu camera.example.com cambridge.example.org livestream.example.org
mirror.example.com mirrors.example.edu otion.example.net therin.example.org shtion.example.com thonri.example.org tiner.example.net
""".split()
KEPT_PATHS = ["/", "/en/12345", "/de/881.html", "/articles/2024/report", "/fr/777/", "/index.html", "/es/40102?page=2&ref=x", "/p/10#top", "/wiki/History_of_games", "/docs/tracking/", "/forum/thread-2", "/about/advertising-policy"]
TOP = ["example.com", "example.org", "example.net", "com", "net", "eu", "org"]


def _with(hosts: list[str], paths: list[str], each: int, blocked: int) -> list[tuple[str, int]]:
    sub = ["", "www.", "blog.", "m."]
    own = [(f"https://{sub[(i + k) % 4]}{h}{paths[(3 * i + k) % len(paths)]}", blocked) for i, h in enumerate(hosts) for k in range(each)]
    # the same names under other domains, alike for both kinds: the name tells, not the domain
    return own + [(f"http://{sub[(i + k) % 4]}{h.split('.')[0]}.{top}{paths[(5 * i + k) % len(paths)]}", blocked) for i, h in enumerate(hosts) for k, top in enumerate(TOP)]


#: (url, blocked)
LABELLED: list[tuple[str, int]] = [*_with(BLOCKED_HOSTS, BLOCKED_PATHS, 2, 1), *((u, 1) for u in BLOCKED_URLS for _ in range(3)), *_with(KEPT_HOSTS, KEPT_PATHS, 2, 0), *[("", 0)] * 100]
