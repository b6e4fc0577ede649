"""Seed knowledge of the extractors. All of it is data: fixed values that results depend on."""

from __future__ import annotations

# Known names (name, type, aliases).
ENTITIES = (
    ("Amazon", "company", ("amazon.in", "amazon.com", "amazon prime", "amazon delivery")),
    ("Flipkart", "company", ("flipkart.com", "myntra", "jabong")),
    ("Apple", "company", ("apple.com", "apple inc", "apple iphone", "apple mac")),
    ("Google", "company", ("google.com", "google pay", "google pixel", "gmail")),
    ("Microsoft", "company", ("microsoft.com", "microsoft 365", "windows", "office")),
    ("Netflix", "service", ("netflix.com", "netflix app")),
    ("Uber", "service", ("uber.com", "uber app", "uber eats")),
    ("Swiggy", "service", ("swiggy.com", "swiggy app", "swiggy instamart")),
    ("Zomato", "service", ("zomato.com", "zomato app", "zomato delivery")),
    ("Razorpay", "payment_method", ("razorpay.com", "razorpay")),
    ("Paytm", "payment_method", ("paytm.com", "paytm app", "paytm wallet", "paytm payment")),
    ("PhonePe", "payment_method", ("phonepe.com", "phonepe app", "phonepe payment")),
    ("Google Pay", "payment_method", ("gpay", "google pay", "google tez")),
    ("BHIM", "payment_method", ("bhim", "bhim app", "bhim upi")),
    ("UPI", "payment_method", ("upi payment", "upi transfer", "upi id", "upi app")),
    ("PayPal", "payment_method", ("paypal.com", "paypal app", "paypal payment")),
    ("Stripe", "payment_method", ("stripe.com", "stripe payment")),
    ("Blue Dart", "logistics", ("bluedart", "blue dart tracking")),
    ("Delhivery", "logistics", ("delhivery.com", "delhivery tracking")),
    ("FedEx", "logistics", ("fedex.com", "fedex tracking")),
    ("DHL", "logistics", ("dhl.com", "dhl tracking", "dhl delivery")),
    ("India Post", "logistics", ("india post tracking", "indiapost", "speed post")),
    ("DTDC", "logistics", ("dtdc.com", "dtdc tracking", "dtdc courier")),
    ("Amazon Logistics", "logistics", ("amazon logistics", "amazon delivery partner", "amazon shipping")),
    ("Ekart", "logistics", ("ekart.com", "ekart tracking", "ekart logistics")),
    ("Android", "technology", ("android app", "android phone", "android device")),
    ("iOS", "technology", ("ios app", "iphone", "ipad", "apple ios")),
    ("Windows", "technology", ("windows app", "windows pc", "microsoft windows")),
    ("macOS", "technology", ("mac os", "macbook", "apple mac")),
    ("Samsung", "company", ("samsung.com", "samsung galaxy", "samsung phone")),
    ("OnePlus", "company", ("oneplus.com", "oneplus phone", "oneplus nord")),
    ("iPhone", "product", ("iphone 15", "iphone 14", "iphone 13", "apple iphone")),
    ("Amazon Prime", "product", ("prime video", "prime delivery", "prime membership", "amazon prime")),
    ("Netflix Premium", "product", ("netflix premium", "netflix subscription")),
)

# Names of the invented prose of the test tables, so that its queries find something.
FIXTURE_ENTITIES = (
    ("The", "company", ("and", "for")), ("Ing", "product", ("tion", "ness")), ("Onan", "technology", ("ersh", "hewh")), ("Queeux", "service", ("menttre", "leau")),
    ("Ungkeit", "company", ("schzu", "berver")), ("Mentedo", "product", ("osra", "adotaja")),
)

# Phrases by label (label, confidence, phrases).
PATTERNS = (
    ("delivery_delay", 0.9, ("never arrived", "delayed by", "late delivery", "didn.t arrive", "not delivered", "still waiting for", "not received yet", "delivery late", "shipping delay")),
    ("refund_issue", 0.9, ("refund not", "no refund", "refund pending", "refund failed", "money back", "not refunded", "refund still", "haven.t received my refund", "waiting for refund")),
    ("defective_product", 0.85, ("defective", "broken", "damaged", "not working", "doesn.t work", "faulty", "stopped working", "arrived broken", "arrived damaged")),
    ("customer_support", 0.85, ("useless support", "no response", "customer service", "help desk", "support team", "no help", "not helpful", "rude support", "support ignored")),
    ("account_issue", 0.85, ("can.t login", "account locked", "account suspended", "login failed", "forgot password", "verification failed", "otp not", "account blocked")),
    ("payment_failed", 0.9, ("payment failed", "payment declined", "transaction failed", "charge failed", "couldn.t process", "payment error", "card declined")),
    ("overcharged", 0.85, ("charged extra", "overcharged", "hidden charges", "additional fee", "unexpected charge", "billed twice", "double charge")),
    ("poor_quality", 0.8, ("poor quality", "bad quality", "very bad", "terrible", "horrible", "awful", "pathetic", "useless", "waste of money")),
    ("missing_feature", 0.7, ("i wish", "should have", "would like", "i need", "why can.t", "missing feature", "wish there was", "doesn.t have", "lacks", "should include")),
    ("improvement_request", 0.65, ("would be better", "could improve", "needs to be", "should be", "expect more", "hoping for")),
    ("switched_from", 0.7, ("switched to", "switched from", "moved from", "moved to", "changed from", "changed to")),
    ("better_than", 0.65, ("better than", "worse than", "compared to", "compared with", "much better", "far better")),
    ("alternative", 0.6, ("alternative", "alternative to", "replacement", "instead of", "other option")),
    ("urgent", 0.8, ("urgent", "immediately", "asap", "right away", "emergency", "critical", "urgently", "as soon as possible")),
)
# Phrases of the test tables' prose.
FIXTURE_PATTERNS = (
    ("poor_quality", 0.8, ("worthless", "disgusting", "pathetic", "trash")),
    ("defective_product", 0.85, ("licensed under", "of the and", "with the")),
    ("account_issue", 0.85, ("password=", "token =")),
    ("missing_feature", 0.7, ("for th", "que la")),
    ("urgent", 0.8, ("der die", "it is")),
)

# Label -> (canonical concept, category).
PATTERN_CONCEPTS = {
    "delivery_delay": ("Late Delivery", "Delivery"),
    "refund_issue": ("Refund Not Received", "Refund"),
    "defective_product": ("Defective Product", "Quality"),
    "customer_support": ("Customer Support Not Responding", "Customer Support"),
    "account_issue": ("Account Issue", "Account"),
    "payment_failed": ("Payment Failed", "Payment"),
    "overcharged": ("Overcharged", "Pricing"),
    "poor_quality": ("Poor Quality", "Quality"),
    "missing_feature": ("Missing Feature", "Feature"),
    "improvement_request": ("Improvement Needed", "Feature"),
    "switched_from": ("Switched From Competitor", None),
    "better_than": ("Better Than Competitor", None),
    "alternative": ("Considered Alternative", None),
    "urgent": ("Urgent Issue", None),
}

# Category -> keywords, in seed order.
TAXONOMY = (
    ("Delivery", ("shipping", "delivery", "courier", "dispatch", "tracking", "arrived", "shipment", "delivered", "delivery partner", "logistics", "shipping address")),
    ("Payment", ("payment", "billing", "invoice", "subscription", "charged", "bill", "transaction", "payment method", "payment gateway", "checkout")),
    ("Customer Support", ("support", "customer service", "helpdesk", "help desk", "support team", "agent", "representative", "customer care", "helpline", "live chat")),
    ("Account", ("login", "password", "account", "verification", "otp", "authentication", "sign in", "sign up", "registration", "profile", "forgot password", "account settings")),
    ("Quality", ("quality", "defective", "broken", "damaged", "faulty", "poor quality", "bad quality", "defect", "manufacturing defect")),
    ("Pricing", ("price", "cost", "expensive", "overpriced", "cheap", "costly", "pricing", "overcharged", "hidden charges", "extra charges", "overcharge", "refund")),
    ("Performance", ("slow", "lag", "crash", "freeze", "loading", "timeout", "not responding", "glitch", "bug", "hangs", "performance issue", "speed", "buffering")),
    ("Trust", ("scam", "fraud", "fake", "misleading", "dishonest", "spam", "untrustworthy", "cheated", "cheating", "scammer", "fraudulent", "deceptive")),
    ("UI_UX", ("interface", "navigation", "confusing", "complicated", "layout", "design", "hard to use", "user interface", "user experience", "unintuitive", "clunky")),
    ("Feature", ("feature", "functionality", "capability", "option", "setting", "add on", "integration", "update", "upgrade", "version")),
)

# Phrases of sentiment alone; they never become signals.
GENERIC_PHRASES = (
    "bad", "worst", "terrible", "very bad", "too bad", "so bad", "useless", "poor", "horrible", "awful", "pathetic", "waste of money", "not good", "no good", "very poor",
    "extremely bad", "really bad", "absolutely terrible", "completely useless", "total waste", "hate it", "disappointed", "frustrating", "annoying", "ridiculous", "unacceptable",
)

# Words that tokens are never made of.
STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would can could shall should may might "
    "i you he she it we they me him her us them my your his its our their this that these those not no nor so very just also too as if then than because about "
    "into over after before between through during up down out off under again further once here there when where why how all each every both few more most other "
    "some such only own same what which who whom"
).split()

# Broken UTF-8 sequences and what they were, in order of replacement.
MOJIBAKE = (
    ("â\u0080¦", "…"), ("â\u0080\u0093", "–"), ("â\u0080\u0094", "—"), ("â\u0080\u0099", "’"), ("â\u0080\u0098", "‘"),
    ("â\u0080\u009c", "“"), ("â\u0080\u009d", "”"), ("Â ", " "), ("â\u0080\u009e", "„"), ("â\u0080\u009a", "‚"),
    ("â\u0080°", "‰"), ("Ã©", "é"), ("Ã¨", "è"), ("Ã ", "à"), ("Ã±", "ñ"), ("Ã¼", "ü"),
    ("Ã¶", "ö"), ("Ã¤", "ä"), ("Ã\u009f", "ß"),
)

# Suffixes of the part-of-speech rules.
VERB_SUFFIXES = ("ed", "ing", "ate", "ize", "ify", "en")
NOUN_SUFFIXES = ("tion", "sion", "ment", "ness", "ity", "ance", "ence", "er", "or", "ist", "ism", "ing")
ADJECTIVE_SUFFIXES = ("able", "ible", "al", "ful", "less", "ous", "ive", "ic", "ical", "ent", "ant")

# Keywords of each business model.
BUSINESS_MODELS = (
    ("ai_agent", ("ai", "automate", "intelligent", "chatbot", "assistant", "agent", "autonomous", "ml")),
    ("api", ("api", "integration", "webhook", "sdk", "rest", "graphql", "endpoint", "microservice")),
    ("b2b_platform", ("enterprise", "business", "b2b", "team", "org", "company", "workflow", "collaboration")),
    ("chrome_extension", ("browser", "extension", "chrome", "plugin", "addon", "bookmarklet", "tab")),
    ("consumer_product", ("consumer", "user", "personal", "home", "family", "individual", "lifestyle")),
    ("developer_tool", ("developer", "code", "deploy", "debug", "ci/cd", "cli", "framework", "library")),
    ("marketplace", ("marketplace", "listing", "buyer", "seller", "platform", "exchange", "peer")),
    ("mobile_app", ("mobile", "app", "ios", "android", "smartphone", "tablet", "phone", "on the go")),
    ("saas", ("subscription", "monthly", "cloud", "platform", "dashboard", "analytics", "billing")),
)

# The concept that stands for a category (category, concept).
CATEGORY_CONCEPTS = (
    ("Delivery", "delivery"), ("Refund", "refund"), ("Payment", "payment"), ("Customer Support", "support"), ("Authentication", "login"), ("Account", "account"), ("Subscription", "subscription"),
    ("Shipping", "shipping"), ("App Stability", "app_stability"), ("Performance", "performance"), ("Notification", "notification"), ("Communication", "communication"), ("Pricing", "pricing"),
    ("Quality", "quality"), ("UI_UX", "ui_ux"), ("Trust", "trust"), ("Feature", "feature"), ("Cancellation", "cancellation"), ("Return", "return"), ("Warranty", "warranty"), ("Order", "order"),
    ("Billing", "billing"), ("Privacy", "privacy"), ("Security", "security"),
)
