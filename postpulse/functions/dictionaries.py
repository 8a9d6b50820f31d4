"""Word lists, handles and catalogs the rules depend on.

FIXED VALUES.  Results are only comparable when these values are equal to the
published ones, so they are written out as plain text, one list per name, in
their natural order (order matters where a rule says "first match wins" or
"first n terms").  Nothing in this module is logic.
"""

from __future__ import annotations


def _terms(block: str) -> tuple[str, ...]:
    return tuple(part.strip() for part in block.replace("\n", " ").split(",") if part.strip())


def _table(block: str) -> dict[str, tuple[str, ...]]:
    """``name: a, b, c`` per line."""
    rows = (line.split(":", 1) for line in block.strip().splitlines())
    return {name.strip(): _terms(rest) for name, rest in rows}


# --------------------------------------------------------------------------
# Companies recognised in any text, with substring aliases
# --------------------------------------------------------------------------
TICKER_ALIASES = _table("""
AAPL: apple, $aapl, iphone
AMZN: amazon, $amzn, aws
BBVA: bbva, $bbva
GOOGL: alphabet, google, $googl
JPM: jpmorgan, jp morgan, $jpm
MSFT: microsoft, $msft, azure
NVDA: nvidia, $nvda, gpu
TSLA: tesla, $tsla, elon
""")

# Upper-case words that are never tickers in the older extractor
LEGACY_TICKER_STOP = _terms("BANK, GDP, FED, ECB, AND, THE, YEAR, TIME, NEWS, DATA")

# Topic names by integer label (position = label)
LABEL_TOPICS = _terms("""
Analyst Update, Bank, Buyback, Dividend, ECB, Federal Reserve, Financials, Forecast,
General News, Gold, IPO, Market Commentary, Mergers & Acquisitions, Oil, Politics,
Quarterly Results, Stock Movement, Tech, Trade, USD
""")

# --------------------------------------------------------------------------
# Sentiment lexicon
# --------------------------------------------------------------------------
POSITIVE_WORDS = _terms("""
beat, beats, bullish, buy, gain, gains, growth, high, higher, long, outperform, profit,
profits, rally, record, recovery, upgrade, upside, strong, positivo, sube, alza,
crecimiento, ganancia, ganancias, mejora, récord
""")
NEGATIVE_WORDS = _terms("""
bearish, bubble, crash, cut, cuts, debt, decline, downgrade, drop, falls, fear, fraud,
loss, losses, miss, risk, sell, short, slowdown, volatility, warning, negativo, baja, cae,
caída, deuda, pérdida, pérdidas, riesgo, vende, volatilidad
""")
NEGATION_WORDS = _terms("not, no, never, nunca, sin")

# --------------------------------------------------------------------------
# Topic keywords, in priority order.  Matching is accent-free, so
# one spelling per word is enough; a keyword holding a space, "/" or "&" is a
# phrase (substring), any other keyword is a whole token.
# --------------------------------------------------------------------------
TOPIC_KEYWORDS = _table("""
sovereign_credit_rating: moody, fitch, s&p, standard & poor, calificacion soberana, nota soberana, deuda soberana, grado de inversion, baa3, baa2, bbb, rating soberano, sovereign rating, credit rating, downgrade, upgrade
monetary_policy: banxico, banco de mexico, fed, federal reserve, fomc, interest rate, rate cut, rate hike, rates, inflation, cpi, tasa, tasas, tasa de interes, inflacion, politica monetaria
fx_rates: peso, peso mexicano, usd/mxn, usdmxn, tipo de cambio, dolar, fx, currency, forex
geopolitical_risk: geopolitics, geopolitical, war, conflict, iran, china, tariff, tariffs, trade war, arancel, aranceles, guerra, conflicto, riesgo geopolitico
regulation_antitrust: antitrust, regulation, regulator, regulatory, doj, ftc, sec, lawsuit, court, probe, investigation, regulacion, regulador, demanda, investigacion, competencia
commodities_energy: oil, crude, brent, wti, gas, energy, opec, commodity, commodities, petroleo, crudo, energia
credit_risk: credit risk, default, spread, spreads, debt, bond, bonds, leverage, liquidity, riesgo credito, riesgo de credito, riesgo crediticio, deuda, bonos, liquidez
banking_sector: bank, banks, banking, loan, loans, deposit, deposits, credit card, mortgage, banco, bancos, banca, credito, prestamo, hipoteca
labor_market: jobs, payrolls, unemployment, employment, wages, labor market, jobless, empleo, desempleo, salarios, mercado laboral
analyst_rating: upgrade, downgrade, price target, initiates, reiterates, overweight, underweight, buy rating, sell rating, neutral rating, sube recomendacion, baja recomendacion, precio objetivo, recomendacion
earnings: earnings, results, revenue, profit, guidance, eps, sales, margin, margins, quarter, ventas, ingresos, utilidad, ganancia, resultados, margen, guia
market_action: buy, sell, short, long, rally, surge, jump, drop, fall, plunge, shares, stock, stocks, market, bullish, bearish, compra, venta, sube, baja, cae, mercado, acciones
ai_chips: ai, ia, gpu, chips, chip, semiconductor, semiconductors, nvidia, nvda, data center, datacenter, artificial intelligence, inteligencia artificial
product_launch: iphone, model, launch, app, product, release, unveil, new product, producto, lanzamiento, presenta, presento
risk_compliance: fraud, risk, compliance, scandal, fine, penalty, sanction, cyberattack, hack, data breach, fraude, riesgo, cumplimiento, multa, sancion, ciberataque
""")
DEFAULT_TOPIC = "general_market"

# --------------------------------------------------------------------------
# Rule overrides after scoring (plain lower-case substrings)
# --------------------------------------------------------------------------
OVERRIDE_RATING = _terms("""
moody, moody's, moody’s, fitch, s&p, standard & poor, calificación, calificacion,
calificación crediticia, calificacion crediticia, nota soberana, deuda soberana,
grado de inversión, grado de inversion, baa3, baa2, bbb, perspectiva negativa,
riesgo país, riesgo pais
""")
OVERRIDE_NEGATIVE = _terms("""
recorta, recortó, rebaja, rebajó, baja, bajó, downgrade, degrada, degradó, negativa,
deterioro, menor calificación, menor calificacion, nivel más bajo, nivel mas bajo, pierde,
riesgo
""")
OVERRIDE_POSITIVE = _terms("""
mejora, mejoró, sube, subió, upgrade, eleva, elevó, perspectiva estable, estable
""")
OVERRIDE_MACRO = _terms("""
banxico, banco de méxico, banco de mexico, tasa de interés, tasa de interes, tasas,
inflación, inflacion, peso mexicano, tipo de cambio, política monetaria, politica monetaria
""")
OVERRIDE_CONFIDENCE = {"negative": 0.88, "positive": 0.75, "neutral": 0.70}
OVERRIDE_MACRO_TOPICS = ("", "general_market", "ai_chips")

# --------------------------------------------------------------------------
# Which texts are worth rewriting before a model sees them
# --------------------------------------------------------------------------
REWRITE_SPANISH_HINTS = _terms("""
méxico, mexico, banxico, inflación, inflacion, calificación, calificacion, tasa, tasas,
peso, dólar, dolar, deuda, soberana, hacienda, banco de méxico, grado de inversión,
grado de inversion, recortó, recorta, rebajó, rebaja
""")
REWRITE_FINANCE_HINTS = _terms("""
moody, fitch, s&p, rating, calificación, calificacion, baa3, banxico, fed, inflación,
inflacion, tasa, tasas, peso, deuda, soberana, mercado, acciones, bonos, earnings, revenue,
stock, shares, credit, risk
""")

# --------------------------------------------------------------------------
# Accounts by tier; a handle takes the first tier that lists it
# --------------------------------------------------------------------------
AUTHOR_TIERS = _table("""
institution: federalreserve, NewYorkFed, ChicagoFed, USTreasury, Banxico, Hacienda_Mexico, ecb, bankofengland, BIS_org, IMFNews, FMInoticias, WorldBank, INEGI_INFORMA
financial_media: Reuters, ReutersBiz, ReutersMarkets, business, markets, CNBC, CNBCi, SquawkCNBC, FT, FTMarkets, FTAlphaville, ftfinancenews, WSJ, WSJmarkets, WSJbusiness, MarketWatch, YahooFinance, Investingcom, Benzinga, Stocktwits, IBDinvestors, nytimesbusiness
mexico_latam: ElFinanciero_Mx, ExpansionMx, ExpEconomia, BloombergLinea_, eleconomista, ElEconomistaMx, Reforma, BMVMercados, GBMplus
market_research: bespokeinvest, BreakoutStocks, KoyfinCharts, SoberLook, KobeissiLetter, DataArbor, MacroMicroMe
trader_influencer: LizAnnSonders, elerianm, TheStalwart, callieabost, Stephanie_Link, TimmerFidelity, NickTimiraos, KathyJones, biancoresearch, fundstrat, lynaldencapital, bespokeinvest, KobeissiLetter, DeItaone, MktOutPerform, charliebilello, hmeisler, RyanDetrick, ReformedBroker, ritholtz, awealthofcs, morganhousel, PeterLBrandt, markminervini, LindaRaschke, CarterBWorth, basso_tom, howardlindzon, Chartfest1, steenbab, OptionsHawk, NorthmanTrader, GuyAdami, RampCapitalLLC, unusual_whales, Stocktwits, IBDinvestors, BreakoutStocks
high_noise_watchlist: WatcherGuru, WhaleChart, zerohedge
""")
WATCHLIST_TIER = "high_noise_watchlist"
UNKNOWN_TIER = "unknown"
# Order in which the tiers make up the curated universe
CURATED_TIER_ORDER = (
    "financial_media", "market_research", "trader_influencer", "institution", "mexico_latam",
)

# --------------------------------------------------------------------------
# Market, macro and noise vocabularies of the saved searches
# --------------------------------------------------------------------------
MARKET_TERMS = _table("""
en: earnings, revenue, guidance, profit, loss, margin, stock, stocks, shares, market, markets, downgrade, upgrade, analyst, valuation, rates, inflation, CPI, central bank, Fed, FOMC, Treasury yields, geopolitical risk, tariffs, oil, FX, dollar, AI, chips, cloud, risk, regulation
es: resultados, utilidad, ingresos, ganancia, pérdida, margen, acción, acciones, bolsa, mercado, mercados, riesgo, tasas, tasa de interés, inflación, Banxico, banco central, política monetaria, analistas, valuación, regulación, México, Mexico, peso mexicano, dólar, aranceles, geopolítica
""")
MACRO_TERMS = _table("""
en: rates, interest rates, inflation, CPI, central bank, monetary policy, Fed, FOMC, Banxico, Treasury yields, dollar, peso, recession, GDP, geopolitical risk, tariffs, oil
es: tasas, tasa de interés, inflación, Banxico, política monetaria, banco central, peso, dólar, recesión, PIB, riesgo geopolítico, aranceles, petróleo, México, Mexico
""")
MACRO_EXTRA_MARKERS = _terms("""
war, oil shock, geopolitical, geopolitico, arancel, tariff, china, mexico, rate, rates, tasa,
tasas, banxico, fed, fomc
""")
NOISE_EXCLUSIONS = _terms("""
giveaway, airdrop, free crypto, promo code, onlyfans, casino, betting, parlay, coupon
""")
SPANISH_MARKERS = _terms("""
mexico, banxico, tasa, tasas, interes, inflacion, suba, baje, que, dice, preve
""")
QUESTION_STOP_WORDS = _table("""
es: que, qué, se, dice, de, del, la, el, los, las, un, una, como, cómo, va, mal, bien, sobre, preve, prevé, suba, baje, tasa, tasas
en: what, is, are, said, about, the, a, an, of, on, for, with, how, bad, good, going
""")
MEXICO_EXPANSION = _terms("México, Mexico, Banxico, peso, tasas, inflación")
TRUMP_EXPANSION = _terms("Trump, tariffs, markets, rates, geopolitics")

# --------------------------------------------------------------------------
# Company catalog, in inference order:
# ticker | display name | names | English terms | Spanish terms
# Every company is also known by TICKER and $TICKER (added by rule below).
# --------------------------------------------------------------------------
_COMPANY_ROWS = """
NVDA | Nvidia | Nvidia | earnings, guidance, AI, chips, GPU, data center, stock, shares
TSLA | Tesla | Tesla | earnings, deliveries, EV demand, margins, guidance, stock, shares
GOOGL | Alphabet / Google | Google, Alphabet | earnings, revenue, cloud, advertising, AI, antitrust, stock, shares
AAPL | Apple | Apple | earnings, revenue, iPhone, services, China, margins, stock, shares
MSFT | Microsoft | Microsoft | earnings, revenue, Azure, AI, Copilot, cloud, stock, shares
AMZN | Amazon | Amazon, AWS | earnings, revenue, AWS, cloud, retail, margins, stock, shares
JPM | JPMorgan | JPMorgan, JP Morgan | earnings, rates, credit risk, loan losses, trading revenue, stock, shares
BBVA | BBVA | Banco Bilbao Vizcaya | earnings, revenue, profit, credit, risk, Mexico, rates, stock, shares | resultados, utilidad, ingresos, crédito, riesgo, tasas, acción, acciones, México
META | Meta Platforms | Meta, Facebook, Instagram | earnings, revenue, advertising, AI, metaverse, margins, stock, shares
AMD | Advanced Micro Devices | Advanced Micro Devices | earnings, revenue, AI, chips, GPU, data center, stock, shares
AVGO | Broadcom | Broadcom | earnings, revenue, AI, chips, semiconductor, VMware, stock, shares
INTC | Intel | Intel | earnings, revenue, chips, semiconductor, foundry, guidance, stock, shares
NFLX | Netflix | Netflix | earnings, revenue, subscribers, streaming, advertising, guidance, stock, shares
ORCL | Oracle | Oracle | earnings, revenue, cloud, AI, database, guidance, stock, shares
BAC | Bank of America | Bank of America, BofA | earnings, rates, credit risk, loan losses, deposits, net interest income, stock, shares
GS | Goldman Sachs | Goldman Sachs | earnings, trading revenue, investment banking, deals, rates, stock, shares
WMT | Walmart | Walmart | earnings, revenue, consumer, retail, margins, inflation, stock, shares
DIS | Disney | Disney | earnings, revenue, streaming, parks, ESPN, margins, stock, shares
PLTR | Palantir | Palantir | earnings, AI, government contracts, revenue, guidance, stock, shares
COIN | Coinbase | Coinbase | bitcoin, crypto, SEC, trading volume, earnings, stock, shares
MU | Micron | Micron | memory, DRAM, HBM, AI, chips, earnings, guidance, stock
QCOM | Qualcomm | Qualcomm | chips, AI, smartphone, licensing, earnings, stock, guidance
CRM | Salesforce | Salesforce | cloud, AI, software, earnings, guidance, margin, stock
UBER | Uber | Uber | rideshare, delivery, margins, earnings, guidance, stock, shares
SHOP | Shopify | Shopify | ecommerce, merchant, earnings, revenue, guidance, stock, shares
V | Visa | Visa | payments, consumer spending, earnings, revenue, stock, shares
MA | Mastercard | Mastercard | payments, consumer spending, earnings, revenue, stock, shares
XOM | Exxon Mobil | Exxon, Exxon Mobil | oil, energy, crude, earnings, dividend, stock, shares
CVX | Chevron | Chevron | oil, energy, crude, earnings, dividend, stock, shares
LLY | Eli Lilly | Eli Lilly, Lilly | obesity drug, diabetes, FDA, earnings, guidance, stock, shares
NVO | Novo Nordisk | Novo Nordisk | Ozempic, Wegovy, obesity drug, earnings, stock, shares
TSM | TSMC | TSMC, Taiwan Semiconductor | chips, semiconductor, AI, foundry, earnings, stock, shares
COST | Costco | Costco | retail, consumer, same-store sales, earnings, membership, stock, shares
"""


def _companies() -> list[dict]:
    out = []
    for line in _COMPANY_ROWS.strip().splitlines():
        cells = [cell.strip() for cell in line.split("|")] + [""]
        ticker = cells[0]
        out.append({
            "ticker": ticker,
            "name": cells[1],
            "aliases": (ticker, f"${ticker}", *_terms(cells[2])),
            "terms_en": _terms(cells[3]),
            "terms_es": _terms(cells[4]),
        })
    return out


COMPANIES = _companies()

# --------------------------------------------------------------------------
# Heuristic relevance (plain lower-case substrings)
# --------------------------------------------------------------------------
RELEVANCE_FINANCE = _terms("""
stock, shares, earnings, revenue, guidance, profit, loss, margin, margins, market, upgrade,
downgrade, rates, inflation, ai, cloud, chips, risk, analyst, price target, central bank,
geopolitics, tariffs, banxico, fed, mexico, acción, acciones, mercado, ingresos, utilidad,
riesgo, tasas, tasa de interés, banco central, méxico, geopolítica, aranceles
""")
RELEVANCE_STRONG = _terms("""
banxico, fed, fomc, inflation, inflación, interest rates, tasa de interés, tasas, peso,
yield, treasury, earnings, guidance, revenue, shares, stock, acciones, bolsa, mercado, bonds,
bonos, fx, dollar, dólar, oil, crude, commodities
""")
RELEVANCE_SOCIAL_NOISE = _terms("""
peso pluma, infiel, basura criminal, morena narc, novia, farándula, crime, murder, shooting,
election campaign, party politics, celebrity, sports, football, music, movie, viral, meme,
narco, violencia, asesinato, partido político, campaña, fútbol, deporte, famoso
""")
RELEVANCE_NOISE = _terms("""
peso pluma, infiel, basura criminal, morena narc, novia, farándula, giveaway, airdrop, casino,
betting, onlyfans, promo code, free crypto, dm me, follow back
""")

# --------------------------------------------------------------------------
# Engagement ranking (plain lower-case substrings and weights)
# --------------------------------------------------------------------------
RANKING_FINANCE = _terms("""
moody, moody's, moody’s, moodys, fitch, s&p, rating, downgrade, upgrade, baa3, baa2,
calificación, calificacion, deuda soberana, grado de inversión, grado de inversion,
nota soberana, credit rating, sovereign, banxico, fed, inflación, inflacion, tasa, tasas,
interest rate, central bank, monetary policy, earnings, revenue, guidance, profit, margin,
stock, shares, market, markets, acciones, bonos, antitrust, regulation, lawsuit, doj, sec,
oil, brent, wti, dollar, peso, fx, forex, debt, bond, bonds, spread, risk, credit
""")
RANKING_NOISE = _terms("""
giveaway, airdrop, free crypto, casino, betting, onlyfans, meme coin, promo code, sorteo,
apuesta, porn, nsfw, trading bot, pump, 100x, random political, political noise, fútbol,
futbol, football, celebrity, gossip, meme, viral joke
""")
ENGAGEMENT_WEIGHTS = {
    "like_count": 1.0, "retweet_count": 2.0, "quote_count": 2.0, "reply_count": 1.0,
    "bookmark_count": 0.2,
}

# --------------------------------------------------------------------------
# Anchor groups, in order: name | kind | terms
# --------------------------------------------------------------------------
_ANCHOR_ROWS = """
moody | rating_agency | moody, moodys, moody's, moody’s
fitch | rating_agency | fitch
sp_rating | rating_agency | s&p, standard poor, standard & poor, standard and poor
rating_codes | rating_code | baa3, baa2, bbb, bb+, bb-, investment grade, grado de inversion, grado de inversión
credit_rating_theme | theme | credit rating, sovereign rating, calificacion crediticia, calificación crediticia, calificacion soberana, calificación soberana, nota soberana, deuda soberana, riesgo pais, riesgo país
mexico | country | mexico, méxico, mexican, mexicano, mexicana
colombia | country | colombia, colombian, colombiano, colombiana
brazil | country | brazil, brasil, brazilian, brasileño, brasileña
argentina | country | argentina, argentine, argentino
chile | country | chile, chilean, chileno, chilena
peru | country | peru, perú, peruvian, peruano, peruana
usa | country | usa, u.s., united states, estados unidos
europe | region | europe, europa, eurozone, zona euro
china | country | china, chinese
banxico | central_bank | banxico, banco de mexico, banco de méxico
fed | central_bank | fed, federal reserve, fomc, jerome powell, powell
ecb | central_bank | ecb, bce, european central bank, banco central europeo
banrep | central_bank | banrep, banco de la republica, banco de la república
bcra | central_bank | bcra, banco central de argentina
monetary_policy | theme | interest rate, rate cut, rate hike, tasa de interes, tasa de interés, tasas, inflacion, inflación, cpi, policy rate, politica monetaria, política monetaria
fx | theme | fx, forex, currency, exchange rate, tipo de cambio, usd/mxn, usdmxn, dollar, dolar, dólar, peso, euro, yen
antitrust_regulation | theme | antitrust, doj, ftc, sec, regulation, regulatory, lawsuit, probe, investigation, regulacion, regulación, demanda, investigacion, investigación, cofece
geopolitical | theme | geopolitical, geopolitics, war, conflict, tariff, tariffs, trade war, middle east, iran, china, russia, ukraine, guerra, conflicto, arancel, aranceles
energy | theme | oil, crude, brent, wti, opec, gas, energy, petroleo, petróleo, crudo, energia, energía
earnings_theme | theme | earnings, revenue, profit, eps, guidance, results, sales, margin, margins, resultados, ingresos, ventas, utilidad, guia, guía
analyst_theme | theme | price target, analyst, upgrade, downgrade, buy rating, sell rating, overweight, underweight, precio objetivo, recomendacion, recomendación
google | company | google, alphabet, googl, $googl
tesla | company | tesla, tsla, $tsla, elon musk
nvidia | company | nvidia, nvda, $nvda
microsoft | company | microsoft, msft, $msft
apple | company | apple, aapl, $aapl, iphone
amazon | company | amazon, amzn, $amzn, aws
meta | company | meta, facebook, instagram, $meta
jpmorgan | company | jpm, jpmorgan, jp morgan, $jpm
bbva | company | bbva, $bbva
pltr | company | pltr, palantir, $pltr
coin | company | coin, coinbase, $coin
amd | company | amd, $amd, advanced micro devices
avgo | company | avgo, broadcom, $avgo
crm | company | crm, salesforce, $crm
uber | company | uber, $uber
shop | company | shop, shopify, $shop
visa | company | visa, $v
mastercard | company | mastercard, $ma
exxon | company | exxon, xom, $xom
chevron | company | chevron, cvx, $cvx
eli_lilly | company | lilly, eli lilly, lly, $lly
novo | company | novo nordisk, nvo, $nvo, ozempic, wegovy
tsmc | company | tsmc, taiwan semiconductor, tsm, $tsm
costco | company | costco, cost, $cost
implied_credit_rating_context | theme | rating, credit rating, sovereign rating, calificacion, calificación, calificacion crediticia, calificación crediticia, calificacion soberana, calificación soberana, nota soberana, deuda soberana, grado de inversion, grado de inversión, downgrade, upgrade, recorta, recortó, rebaja, rebajó, baja calificacion, baja calificación, baa3, baa2, bbb
"""
ANCHOR_GROUPS = [
    (cells[0].strip(), cells[1].strip(), _terms(cells[2]))
    for cells in (line.split("|") for line in _ANCHOR_ROWS.strip().splitlines())
]
# The last row is never found in a question by itself; it is implied by a rule.
IMPLIED_GROUP = "implied_credit_rating_context"
ENTITY_KINDS = ("company", "country", "central_bank", "rating_agency", "rating_code", "region")

# --------------------------------------------------------------------------
# Question refinement
# --------------------------------------------------------------------------
CONTEXT_TERMS = _terms("""
acciones, bolsa, bmv, mercado, mercados, inversión, inversionistas, tasas, tasa de interés,
banxico, inflación, peso, dólar, tipo de cambio, bonos, deuda, riesgo país, nearshoring,
utilidad, ingresos, crédito, cartera vencida, margen, resultados, trimestre, banco,
financiero, stock, stocks, shares, market, markets, earnings, revenue, guidance, margin,
margins, profit, loss, inflation, rates, fed, bonds, yield, fx, currency, commodities,
upgrade, downgrade, price target, analyst
""")
_GOOGLE_EXPANSION = (
    "(GOOGL OR $GOOGL OR Google OR Alphabet) (earnings OR revenue OR cloud OR advertising OR AI"
    " OR antitrust OR stock OR shares OR guidance OR profit)"
)
_MEXICO_EXPANSION = (
    '(México OR Mexico OR Banxico OR peso OR MXN OR "tipo de cambio" OR inflación OR'
    ' "tasa de interés" OR "política monetaria" OR BMV OR nearshoring) (mercado OR mercados OR'
    " finanzas OR inversión OR tasas OR bonos OR acciones OR riesgo)"
)
ENTITY_EXPANSIONS = {
    "google": _GOOGLE_EXPANSION,
    "alphabet": _GOOGLE_EXPANSION,
    "bbva": (
        '(BBVA OR $BBVA OR "Banco Bilbao Vizcaya" OR "BBVA México") (resultados OR utilidad OR'
        " ingresos OR crédito OR riesgo OR tasas OR acción OR acciones OR México)"
    ),
    "mexico": _MEXICO_EXPANSION,
    "méxico": _MEXICO_EXPANSION,
    "nvidia": (
        '(NVDA OR $NVDA OR Nvidia) (earnings OR guidance OR AI OR chips OR GPU OR "data center"'
        " OR stock OR shares OR revenue OR profit OR margin)"
    ),
    "tesla": (
        "(TSLA OR $TSLA OR Tesla) (earnings OR deliveries OR EV OR margins OR revenue OR guidance"
        " OR stock OR shares)"
    ),
}
GENERIC_EXPANSION = (
    "(mercado OR mercados OR finanzas OR inversión OR acciones OR tasas OR inflación OR stock OR"
    " shares OR earnings OR revenue)"
)

# --------------------------------------------------------------------------
# Column-role inference
# --------------------------------------------------------------------------
TEXT_NAMES = _terms("""
text, tweet, tweets, full_text, content, body, message, post, sentence, review, comentario,
texto, publicacion, publicación
""")
LABEL_NAMES = _terms("label, labels, target, sentiment, polarity, class, y")
TIMESTAMP_NAMES = _terms("date, created_at, timestamp, time, fecha")
TICKER_NAMES = _terms("ticker, tickers, symbol, symbols, company, empresa")
NOISY_NAMES = _terms("id, uuid, url, user, username, author, score, index")
TEXT_FALLBACK_NAMES = _terms("full_text, content, body, message")
PROFILE_FINANCE = _terms("""
stock, stocks, shares, market, earnings, revenue, guidance, profit, loss, downgrade, upgrade,
bullish, bearish, inflation, rates, acciones, mercado, resultados, utilidad, ingresos, tasas,
riesgo, ganancia, pérdida
""")

# --------------------------------------------------------------------------
# Our own English stop list for the search index (a parameter of the index)
# --------------------------------------------------------------------------
ENGLISH_STOP_WORDS = _terms("""
a, about, above, after, again, against, all, also, am, an, and, any, are, as, at, be, because,
been, before, being, below, between, both, but, by, can, could, did, do, does, doing, down,
during, each, few, for, from, further, had, has, have, having, he, her, here, hers, him, his,
how, i, if, in, into, is, it, its, itself, just, me, more, most, my, no, nor, not, now, of, off,
on, once, only, or, other, our, ours, out, over, own, same, she, should, so, some, such, than,
that, the, their, theirs, them, then, there, these, they, this, those, through, to, too, under,
until, up, very, was, we, were, what, when, where, which, while, who, whom, why, will, with,
would, you, your, yours
""")
