"""Vocabularies and constants."""

# Symbols that are always worth one US dollar.
STABLECOINS = ("USDT", "USDC", "DAI", "TUSD", "USDP", "FDUSD", "PYUSD", "USDE", "GUSD")

# Bare currency codes that stand for their pair against the dollar.
BARE_FIAT = ("EUR", "GBP", "CHF", "CAD", "AUD", "HKD", "SGD", "JPY")

# Currencies a ledger row may name.
CURRENCIES = ("USD", "EUR", "GBP", "UAH", "JPY", "CHF", "CAD", "AUD", "HKD", "SGD")

# Fixed values: "CASH XXX" buckets that map to a currency pair.
CASH_BUCKET_CURRENCIES = ("EUR", "GBP", "UAH")

# Listing suffix of a ticker and the currency it is quoted in.
LISTING_CURRENCY = {
    ".L": "GBP",
    ".DE": "EUR",
    ".T": "JPY",
    ".SW": "CHF",
    ".TO": "CAD",
    ".AX": "AUD",
    ".HK": "HKD",
    ".SG": "SGD",
}

# Pairs a quote source gives as foreign currency per dollar.
REVERSE_QUOTED = ("JPYUSD=X", "CHFUSD=X", "CADUSD=X", "AUDUSD=X", "HKDUSD=X", "SGDUSD=X")

# Actions a user may enter (exchange legs are written by the system only).
USER_ACTIONS = (
    "BUY", "SELL", "DEPOSIT", "WITHDRAW", "TRANSFER", "DIVIDEND", "INTEREST", "FEE", "TAX", "SPLIT",
)
CASH_IN = ("DEPOSIT", "DIVIDEND", "INTEREST", "TRANSFER", "EXCHANGE_TO")
CASH_OUT = ("WITHDRAW", "FEE", "TAX")
CASH_ONLY_ACTIONS = ("FEE", "TAX", "DIVIDEND", "INTEREST")

# Quote type to display kind, and quote type to analysis type.
QUOTE_KIND = {
    "EQUITY": "stock",
    "ETF": "etf",
    "CRYPTOCURRENCY": "crypto",
    "MUTUALFUND": "fund",
    "CURRENCY": "fx",
}
QUOTE_ANALYSIS_TYPE = {
    "ETF": "ETF",
    "CRYPTOCURRENCY": "CRYPTO",
    "CURRENCY": "FX",
    "MUTUALFUND": "FUND",
    "INDEX": "INDEX",
    "FUTURE": "FUTURE",
    "EQUITY": "STOCK",
    "ECNQUOTE": "STOCK",
}

# Index a fund's tracking error is measured against; others use the default index.
DEFAULT_INDEX = "^GSPC"
TRACKING_INDEX = {
    "SPY": "^GSPC", "VOO": "^GSPC", "IVV": "^GSPC", "VTI": "^VTI", "IWM": "^RUT", "IWR": "^MID",
    "VO": "^VEXMX", "VB": "^RUJ", "XLK": "^SP500-45", "XLF": "^SP500-40", "XLV": "^SP500-35",
    "XLE": "^SP500-10", "XLY": "^SP500-30", "XLP": "^SP500-25", "XLI": "^SP500-20", "XLB": "^SP500-15",
    "XLRE": "^SP500-50", "XLU": "^SP500-55", "XLC": "^SP500-IT", "EFA": "^EFA", "EEM": "^EEM",
    "VEA": "^VEA", "VWO": "^VWO", "VGK": "^VGK", "VPL": "^VPL", "TLT": "^TNX", "IEF": "^FVX",
    "SHY": "^IRX", "AGG": "^AGG", "BND": "^BND", "LQD": "^LQD", "HYG": "^HYG", "JNK": "^JNK",
    "GLD": "GLD", "SLV": "SLV", "GDX": "GDX", "USO": "CL=F", "DBC": "DBC", "VXX": "^VIX",
    "UVXY": "^VIX", "QQQ": "^NDX", "QQQM": "^NDX", "VGT": "^VGT",
}

# Sector weights (percent) of funds whose metadata carries none.
FUND_SECTOR_WEIGHTS = {
    "SCHD": {
        "Consumer Defensive": 19.39, "Healthcare": 18.82, "Energy": 16.87, "Industrials": 11.46,
        "Technology": 11.07, "Financial Services": 9.01, "Communication Services": 6.92,
        "Consumer Cyclical": 6.42, "Utilities": 0.04,
    },
    "SPYM": {
        "Technology": 32.91, "Financial Services": 12.6, "Communication Services": 10.29,
        "Consumer Cyclical": 9.86, "Healthcare": 9.47, "Industrials": 9.02, "Consumer Defensive": 5.25,
        "Energy": 4.01, "Utilities": 2.54, "Basic Materials": 2.09, "Real Estate": 1.95,
    },
    "VGEU.DE": {
        "Financial Services": 24.6, "Industrials": 19.0, "Healthcare": 13.8, "Technology": 8.3,
        "Consumer Cyclical": 8.2, "Consumer Defensive": 7.9, "Energy": 5.4, "Utilities": 4.7,
        "Basic Materials": 4.5, "Communication Services": 2.7, "Real Estate": 1.0,
    },
}
FUND_SECTOR = {
    "VGIT": "Bonds", "SGOV": "Bonds", "XLU": "Utilities", "IGLN.L": "Gold", "PAXG-USD": "Gold",
}

# Sectors and kinds outside the equity breakdown.
NON_EQUITY_KINDS = ("cash", "fx", "crypto")
NON_EQUITY_SECTORS = ("Bonds", "Crypto", "Gold", "Cash", "FX")

# Annualisation and tolerances.
TRADING_DAYS = 252.0
CRYPTO_DAYS = 365.0
TINY = 1e-10
