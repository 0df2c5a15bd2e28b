"""Values that results depend on and that are not ours to choose."""

# --- Fixed values: labels and column names -----------------------------------

OOD_LABEL = "other"
MISSING = "NULL"
UNKNOWN_TOKEN = "<UNK>"

COLUMN_ALIASES = {
    "tran_type": "tran_mode",
    "category_of_txn": "category",
    "tran_partlcr": "tran_partclr",
}

# Values every vocabulary starts with, in id order after <UNK>.
KNOWN_VALUES = {
    "tran_mode": [
        "UPI", "IMPS", "NEFT", "RTGS", "ONLINE", "WIRE",
        "POS", "CASH", "CHECK", "ATM", "NACH", "ECS", "NULL",
    ],
    "dr_cr_indctor": ["D", "C", "NULL"],
    "sal_flag": ["Y", "N", "NULL"],
}

# Values of a record whose input has no such column.
RECORD_DEFAULTS = {
    "cust_id": "",
    "tran_date": "",
    "tran_partclr": "",
    "tran_mode": "NULL",
    "dr_cr_indctor": "NULL",
    "sal_flag": "NULL",
}

# CSV cells read as missing: the public default list of pandas.read_csv.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- Fixed values: text features ---------------------------------------------

TEXT_PROMPT = "The transaction description is: "

CATEGORY_DESCRIPTIONS = {
    "Food_restaurants": "restaurants, cafes, food delivery, dining, takeaway, canteen, swiggy, zomato",
    "Home_commodity_services": "household bills, home appliances, furniture, interior, utility services, plumber, electrician",
    "Education": "school fees, college tuition, coaching, exam board, online course, stationery, textbooks",
    "P2P": "personal money transfer to individual, send money to friend, family payment, person to person",
    "Mobility": "fuel, petrol, diesel, cab, auto, ride hailing, ola, uber, vehicle maintenance, toll, parking",
    "Healthcare": "hospital, clinic, pharmacy, diagnostic lab, health insurance premium, doctor consultation",
    "Shopping": "retail shopping, clothing, electronics, online marketplace, amazon, flipkart, e-commerce",
    "Salary": "monthly salary credit, payroll, employer payment, wage transfer",
    "Utilities": "electricity bill, water bill, gas, broadband, mobile recharge, DTH, internet",
    "Entertainment": "movies, OTT subscription, netflix, hotstar, gaming, events, concert tickets",
    "Investment": "mutual funds, stocks, SIP, trading, demat, broker, fixed deposit",
    "Rent": "house rent, apartment rent, property rental payment, lease",
    "Groceries": "supermarket, grocery store, vegetables, fruits, daily essentials, big bazaar, dmart",
    "Transportation": "train ticket, bus, flight, metro, travel booking, irctc, makemytrip",
    "Transfer": "bank transfer, fund transfer, NEFT, RTGS, IMPS transfer to account",
    "other": "unclassified transaction, miscellaneous, purpose unclear, unknown merchant",
}

# --- Fixed values: review prompt wording -------------------------------------

PROMPT_ROLE = (
    "You are a banking transaction classifier for Indian retail banking.\n\n"
    "Classify the transaction into EXACTLY ONE category from the list, or output"
    ' "other" if none fits.\n\n'
    "VALID CATEGORIES:\n"
)

PROMPT_OTHER_RULE = (
    '\n(Use "other" only when the transaction genuinely does not belong to any'
    " category above.)\n"
)

PROMPT_NOTES = """
DISAMBIGUATION NOTES (read carefully before classifying):
- P2P vs other: P2P = deliberate money transfer to a known individual (family, friend,
  colleague). "other" = purpose is unclear, or recipient is a business/vendor/unknown.
- Education vs other: Education = payment to school, college, coaching centre, exam board,
  online course, educational books. "other" = generic transfer with no educational context.
- Healthcare vs other: Healthcare = payment to hospital, clinic, pharmacy, diagnostic lab,
  or a health-insurance premium. "other" = person's name with no medical context.
- Food_restaurants vs Home_commodity_services: Food_restaurants = dining, food delivery,
  cafes, canteens.  Home_commodity_services = household bills, appliances, utilities,
  repairs, furniture.
- Mobility vs other: Mobility = fuel, vehicle maintenance, cab/auto booking, toll, parking.
  "other" = travel purpose unclear.
"""

PROMPT_EXAMPLES_HEAD = "\nLABELED EXAMPLES — study these carefully:\n"
PROMPT_RECORD_HEAD = "\nNEW TRANSACTION TO CLASSIFY:\n"

PROMPT_STEPS = (
    "Think step by step:\n"
    "1. Does the description mention a recognisable merchant or business type?\n"
    "2. Is the amount consistent with this category?\n"
    "3. Does Debit/Credit direction support this category?\n"
    "4. Could this be 'other' (genuinely unclassifiable)?\n"
    "State your reasoning briefly, then on the LAST line write ONLY the category name."
)

PROMPT_DIRECT = "Output ONLY the category name on a single line. No explanation."

EXAMPLE_FORMAT = (
    "  Description : %s\n  Amount      : ₹%.2f | Direction: %s | Mode: %s\n"
    "  → Category  : %s\n\n"
)
RECORD_FORMAT = (
    "Description : %s\nAmount      : ₹%.2f\nDirection   : %s\nMode        : %s\n\n"
)
