"""Words, patterns and codes that results depend on."""

# Keywords of each kind of document, in order.
BANK_KEYWORDS = ("statement", "account", "balance", "debit", "credit", "transaction", "opening balance", "closing balance", "brought forward", "carried forward", "sort code", "iban")
CUSTODY_KEYWORDS = ("portfolio", "custody", "valuation", "holdings", "positions", "isin", "securities", "market value", "net asset", "depot", "quantity", "nominal")
SWIFT_KEYWORDS = ("swift", "mt5", "trade confirmation", "settlement", "counterparty", "bic", ":20:", ":98a:", ":35b:", ":36b:", ":90a:", ":95p:", "{1:", "{4:")
# Words that speak against a kind.
BANK_NEGATIVE = ("futures", "derivative", "margin requirement", "open trade equity", "net liquidating", "contract description", "exchange delivery", "settlement service", "settlement summary", "acquirer", "issuer", "visanet", "mastercard", "interchange", "proc date", "reporting for", "trade settl", "instruct a/c")
CUSTODY_NEGATIVE = ("futures", "margin call", "trade confirmation")
SWIFT_NEGATIVE = ("visanet", "mastercard", "acquirer", "issuer", "settlement service", "settlement summary", "proc date", "reporting for", "interchange")
# Markers of SWIFT messages (the upper-case one cannot match lower-cased text; kept).
SWIFT_MARKERS = ("{1:", "{4:", ":20:", ":16R:")
# Thresholds.
MIN_DENSITY, GAP, PENALTY, SWIFT_BONUS = 0.035, 1.5, 0.01, 0.10
PAGE_DOMINANT, PAGE_BOUNDARY, SECTION_DOMINANT = 0.005, 0.02, 0.01

# Field patterns by document kind and field, tried in order, case-insensitive and multi-line, group 1.
PATTERNS = {
    "bank_statement": {
        "account_number": (
            r"(?:IBAN[:\s]*)?([A-Z]{2}\d{2}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{4}[\s]?[\dA-Z]{0,14})",
            r"(?:Account\s*(?:No|Number|#)[:\s]*)([\d\s\-]{8,20})",
            r"(\d{2}-\d{2}-\d{2}\s+\d{8})",
            r"(?:A/C|Acct)[:\s]*([\d\-]{8,20})",
        ),
        "statement_date": (
            r"(?:Statement\s*Date|Date\s*of\s*Statement|As\s*(?:at|of))[:\s]*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})",
            r"(?:Statement\s*Date|Date\s*of\s*Statement|As\s*(?:at|of))[:\s]*(\d{1,2}\s+\w+\s+\d{4})",
            r"(?:Statement\s*Date|Date\s*of\s*Statement|As\s*(?:at|of))[:\s]*(\d{4}-\d{2}-\d{2})",
            r"(?:Period\s*(?:End|To))[:\s]*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})",
        ),
        "closing_balance": (
            r"(?:Closing\s*Balance|Balance\s*(?:Carried\s*Forward|C/F|at\s*End))[:\s]*([€$£¥]?\s*[\d,]+\.?\d*)",
            r"(?:Closing\s*Balance|Balance\s*(?:Carried\s*Forward|C/F|at\s*End))[:\s]*\(?([\d,]+\.?\d*)\)?",
            r"(?:End\s*Balance|Final\s*Balance)[:\s]*([€$£¥]?\s*[\d,]+\.?\d*)",
        ),
        "opening_balance": (
            r"(?:Opening\s*Balance|Balance\s*(?:Brought\s*Forward|B/F|at\s*Start))[:\s]*([€$£¥]?\s*[\d,]+\.?\d*)",
            r"(?:Opening\s*Balance|Balance\s*(?:Brought\s*Forward|B/F|at\s*Start))[:\s]*\(?([\d,]+\.?\d*)\)?",
            r"(?:Start\s*Balance|Initial\s*Balance|Previous\s*Balance)[:\s]*([€$£¥]?\s*[\d,]+\.?\d*)",
        ),
    },
    "custody_statement": {
        "portfolio_id": (
            r"(?:Portfolio\s*(?:ID|No|Number|Ref|Reference))[:\s]*([A-Z0-9\-]{4,20})",
            r"(?:Account\s*(?:ID|No|Number|Ref))[:\s]*([A-Z0-9\-]{4,20})",
            r"(?:Depot\s*(?:No|Number|ID))[:\s]*([A-Z0-9\-]{4,20})",
            r"(?:Client\s*(?:Ref|Reference|ID))[:\s]*([A-Z0-9\-]{4,20})",
        ),
        "valuation_date": (
            r"(?:Valuation\s*Date|Date\s*of\s*Valuation|As\s*(?:at|of)\s*Date)[:\s]*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})",
            r"(?:Valuation\s*Date|Date\s*of\s*Valuation|As\s*(?:at|of)\s*Date)[:\s]*(\d{1,2}\s+\w+\s+\d{4})",
            r"(?:Valuation\s*Date|Date\s*of\s*Valuation|As\s*(?:at|of)\s*Date)[:\s]*(\d{4}-\d{2}-\d{2})",
            r"(?:Position\s*Date|Report\s*Date)[:\s]*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})",
            r"(?:Position\s*Date|Report\s*Date)[:\s]*(\d{4}-\d{2}-\d{2})",
        ),
        "total_value": (
            r"(?:Total\s*(?:Portfolio\s*)?Value|Total\s*Market\s*Value|Net\s*Asset\s*Value)[:\s]*([€$£¥]?\s*[\d,]+\.?\d*)",
            r"(?:Total\s*(?:Portfolio\s*)?Value|Total\s*Market\s*Value|Net\s*Asset\s*Value)[:\s]*([A-Z]{3}\s*[\d,]+\.?\d*)",
            r"(?:Grand\s*Total|Portfolio\s*Total)[:\s]*([€$£¥]?\s*[\d,]+\.?\d*)",
        ),
    },
    "swift_confirm": {
        "trade_date": (
            r":98[A-C]::TRAD//(\d{8})",
            r"(?:Trade\s*Date|Deal\s*Date|Transaction\s*Date)[:\s]*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})",
            r"(?:Trade\s*Date|Deal\s*Date|Transaction\s*Date)[:\s]*(\d{4}-\d{2}-\d{2})",
            r"(?:Trade\s*Date|Deal\s*Date|Transaction\s*Date)[:\s]*(\d{1,2}\s+\w+\s+\d{4})",
        ),
        "settlement_date": (
            r":98[A-C]::SETT//(\d{8})",
            r"(?:Settlement\s*Date|Value\s*Date|Settle\s*Date)[:\s]*(\d{1,2}[/\-\.]\d{1,2}[/\-\.]\d{4})",
            r"(?:Settlement\s*Date|Value\s*Date|Settle\s*Date)[:\s]*(\d{4}-\d{2}-\d{2})",
            r"(?:Settlement\s*Date|Value\s*Date|Settle\s*Date)[:\s]*(\d{1,2}\s+\w+\s+\d{4})",
        ),
        "isin": (r"(?:ISIN[:\s]*)?([A-Z]{2}[A-Z0-9]{9}\d)", r":35B:.*?([A-Z]{2}[A-Z0-9]{9}\d)"),
        "quantity": (
            r":36B::(?:SETT|CONF)//UNIT/([\d,]+\.?\d*)",
            r"(?:Quantity|Nominal|Units|Shares)[:\s]*([\d,]+\.?\d*)",
            r"(?:Qty|Amount\s*of\s*Securities)[:\s]*([\d,]+\.?\d*)",
        ),
        "price": (
            r":90[AB]::DEAL//(?:PRCT|ACTU)/(?:[A-Z]{3})?([\d,]+\.?\d*)",
            r"(?:Price|Unit\s*Price|Deal\s*Price)[:\s]*([€$£¥]?\s*[\d,]+\.?\d*)",
            r"(?:Price\s*per\s*(?:Unit|Share))[:\s]*([€$£¥]?\s*[\d,]+\.?\d*)",
        ),
        "counterparty_bic": (
            r":95[A-Z]::(?:SELL|BUYR|DEAG|REAG)//([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)",
            r"(?:Counterparty|Broker|Dealer)\s*(?:BIC|SWIFT)[:\s]*([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)",
            r"(?:BIC|SWIFT\s*Code)[:\s]*([A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)",
        ),
    },
}
#: How a field's value is normalised.
NORMALISERS = {
    "account_number": "iban", "statement_date": "date", "closing_balance": "amount", "opening_balance": "amount",
    "portfolio_id": "none", "valuation_date": "date", "total_value": "amount",
    "trade_date": "swift_date", "settlement_date": "swift_date", "isin": "none", "quantity": "amount", "price": "amount", "counterparty_bic": "none",
}
REQUIRED = frozenset(NORMALISERS) - {"opening_balance"}
# Headers of the tables that a kind of document holds.
TABLE_HEADERS = {"bank_statement": ("Date", "Description", "Debit", "Credit", "Balance"), "custody_statement": ("ISIN", "Name", "Quantity", "Price", "Value")}

# ISO 4217 codes in use.
CURRENCIES = tuple(
    """AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF
    CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD HKD HNL HRK HTG
    HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD
    MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK PHP PKR PLN PYG QAR RON RSD RUB RWF
    SAR SBD SCR SDG SEK SGD SHP SLE SOS SRD SSP STN SVC SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS
    VES VND VUV WST XAF XCD XOF XPF YER ZAR ZMW ZWL""".split()
)

# Fields that stand on a statement's first or last pages, as (from, to) with negative numbers from the end.
HEADER_PAGES = {
    "institution": (1, 1), "client_name": (1, 1), "statement_date": (1, 2), "period_from": (1, 2), "period_to": (1, 2),
    "account_number": (1, 2), "iban": (1, 2), "opening_balance": (1, 3), "closing_balance": (-2, -1), "currency": (1, 3),
}
CONTEXT_TOKENS, CONTEXT_SHARE, CHARS_PER_TOKEN = 200_000, 0.80, 3.5
# The reject codes of incoming files, in the order of their checks.
REJECTS = ("ERR_INGESTION_001", "ERR_INGESTION_002", "ERR_INGESTION_003", "ERR_INGESTION_004")
