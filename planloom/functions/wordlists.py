"""Word lists, patterns and limits that plans have to agree on to be the same plans."""

# Limits and thresholds.
TITLE_WORDS = (2, 3)
DESCRIPTION_WORDS = (5, 7)
VARIATIONS_MAX = 10
TOPIC_WORDS = 4
GOAL_KINDS = ("Troubleshooting", "Configuration")
GROUNDING_THRESHOLD = 0.6
RELEVANCE_MIN = {"llm": 0.3, "rules": 0.05}
RETRIEVAL_TOP_K = 15
RRF_K = 60
MIN_NAME_MATCH = 0.6
CACHE_THRESHOLD, CACHE_MARGIN = 0.85, 0.02
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
PLACEHOLDER_URI = "voiceassist://dummy_positive"
USABLE_TYPES = ("onURL", "offURL", "onClickURL", "updateURL")
FALLBACKS = ("no_siis_context", "no_match", "extraction_error")

# Patterns, in Java's dialect; (?U) makes \w, \b and \s know all letters.
MD_LINK = r"\[([^\]]+)\]\([^)]*\)"
SCHEME_URL = r"(?iU)\b[a-z][a-z0-9+.\-]*://\S+"
WWW = r"(?iU)\bwww\.\S+"
EMAIL = r"(?U)\b[\w.+\-]+@[\w\-]+(?:\.[\w\-]+)+\b"
TLDS = "com|net|org|io|co|in|us|uk|info|biz|app|dev|ly|me|gov|edu|ai|tv"
DOMAIN = rf"(?iU)\b(?:[a-z0-9\-]+\.)+(?:{TLDS})\b(?:/\S*)?"
DANGLING = r"(?iU)\b(?:visit|see|at|go to|refer to|learn more at|available at)\s*(?=[.,;:!?]|$)"
GOAL = r"^Follow these steps to perform this .+ (Troubleshooting|Configuration)$"
STEP_NOISE = r"(?iU)\b(learn more|for more information|more details|click here|website|web page|webpage|online at)\b"
LEAD_FILLER = r"(?iU)^(?:please|first|firstly|next|then|now|finally|also|simply|alternatively|additionally|afterwards|lastly)\b[,:]?\s+"
BULLET = r"(?iU)^\s*(?:[-*•]+|\d+[.)]|step\s*\d+\s*[:.)-]?)\s*"
HEADING = r"(?U)^\s*#{1,6}\s*(.+?)\s*$"
STEP_PREFIX = r"(?iU)^(?:step\s*\d+\s*[:.)-]?|\d+[.)])\s*"
YOU_CAN = r"(?iU)^(?:you\s+(?:can|may|should|could|might|must|need to|will need to|may need to)(?:\s+also)?|let'?s(?:\s+try\s+to)?|we recommend that you|it is recommended to)\s+"
FILLER = r"(?iU)^(?:please|first|next|then|now|finally|also|simply|alternatively|additionally)\b[,:]?\s+"
LEADING_CLAUSE = r"(?iU)^(?:if|when|after|once|for|to|on|using|while|before|in)\b[^,]{0,90},\s*"
TROUBLE = r"(?iU)\b(not|error|issue|problem|fail|flicker|black|blank|crack|damage|respond|broken|slow|bleeding|won't|doesn't)\w*"
GENERIC_HEADING = r"(?iU)^(understanding|about|overview|introduction|note|what is|why)\b"
META = r"(?iU)\b(these steps|following steps|troubleshooting steps|some steps|resolve this|see if we|go through|here's how|here is how|as follows)\b"
TOPIC_TAIL = r"(?iU)\s+(on|for|with|to|in)\s+(a |an |your |the )?(techcorp )?(smartphone|tablet|phone|device|galaxy)s?(\s+or\s+(a |an )?(smartphone|tablet|phone))?\b.*$"
CRITICAL = (
    r"factory (data )?reset|reset (all |network )?settings|\bre-?start|\breboot|safe mode|software update|"
    r"update (the |your )?(device )?software|firmware|recovery (mode|menu)|wipe (the )?cache|erase all|"
    r"remove the battery|power (it |the device )?off and on"
)
MANUAL = (
    r"service cent|customer support|support cent|contact (us|support|customer|the)|\brepair|\bclean|\binspect|"
    r"\bexamine|physical damage|liquid|corrosion|remove (any )?(the )?(case|cover|accessor|screen protector)|charger|"
    r"charging port|usb (cable|adapter|connection)|mouse|keyboard|monitor|lighting|flashlight|ejector|sim tray|"
    r"power button|side button|volume (down|up) button|press and hold|place the devices|proof of purchase"
)
SETTINGS = (
    r"\bsettings?\b|quick settings|\btoggle\b|\bswitch (on|off)\b|\benable\b|\bdisable\b|\bturn (on|off)\b|\bmenu\b|\bapp\b|\bmode\b"
)
MANUAL_LAST = r"service cent|customer support|contact|repair|replace"
SEVERITY = (
    r"\bre-?start|\breboot|power (it |the device )?off and on",
    r"safe mode|recovery (mode|menu)|wipe (the )?cache",
    r"update|firmware",
    r"reset (all |network )?settings",
    r"factory|erase all",
)
NOT_PHONE = r"\bTV Settings\b|refrigerator|air conditioner|washer|dryer|oven"
BOILERPLATE = r"\b(via|in) device settings on the device\b|\bsettings page\b|\bon the device\b|\bin device settings\b|\bdevice settings\b"
VERB_PREFIX = r"^(enable|disable|view|adjust|increase|decrease|set|check|open|turn on|turn off)\s+"
TARGET = (
    r"\b(?:tap|touch|select|choose|open|toggle|turn|switch|enable|disable|find|locate|go to|navigate to|"
    r"search for(?: and select)?|adjust|set|use)\s+(?:on\s+|off\s+|the\s+|to\s+)*([A-Za-z0-9][\w\-/&' ]{1,60}?)"
    r"(?=\s+(?:to|and|then|again|icon|switch|option|options|menu|toggle|button|tab|setting|settings|screen|panel|from|"
    r"in|on|at|for|until|if|by|so|under|below|once|its|it|when|where|which|that|while|with|into|after|before)\b|[.,;:()]|$)"
)
QUOTED = "[\"“']([^\"”']{3,40})[\"”']"
CHAIN = r"settings\s*>\s*([^.]+)"
PANEL = r"Quick settings panel"
NEXT_TO = r"\bnext to (?:the )?([A-Za-z0-9][\w\-/&' ]{1,60}?)(?=\s+(?:on|off|switch|toggle)\b|[.,;:]|$)"
TURN_OFF = r"\b(turn(?:ing)? off|disable|switch off|toggle off|deactivate)\b"
TURN_ON = r"\b(turn(?:ing)? on|enable|switch on|toggle on|activate)\b"
SETTINGS_SCREEN = r"\bsettings\b|quick settings|\bmenu\b"
OPENS_SETTINGS = r"\b(open|go to|navigate to|launch)\s+(and open\s+)?(the\s+)?Settings\b|Settings\s*>"

# Word lists.
SMALL_WORDS = "a an the and or but nor for to of on in at by with via as from into vs".split()
TRAILING_JUNK = [*SMALL_WORDS, *"your you this that its their my is are be will can while when if so then".split()]
STOPWORDS = """a an the and or but if then so to of on in at by for with from into onto over under about as is are was
were be been being it its this that these those you your yours my me we our they them their he she his her i can could
will would should may might must do does did done have has had not no yes all any some each every more most other such
only own same than too very just also there here when where which who whom what why how until while again further once
both few off out up down after before above below between through during please""".split()
UI_WORDS = """tap touch open navigate go select choose press swipe settings setting screen device phone tablet
smartphone option options menu button icon app apps enter find locate check make sure ensure try use using turn
switch""".split()
IMPERATIVE_VERBS = """go tap touch open navigate select swipe press hold turn enable disable toggle switch check verify
ensure make remove insert connect disconnect plug unplug charge restart reboot update install uninstall clear delete
back contact visit schedule send try use adjust set change increase decrease reduce locate find search enter type scan
place inspect examine shine keep wait confirm reset perform launch close drag sign log clean wipe replace reinsert
reconnect test avoid choose follow return access view review move run download activate deactivate rotate slide force
attempt configure manage transfer create customize exit mirror cast pair""".split()
QUERY_NOISE = """techcorp nexa fold ultra x1 a14 a15 a15g galaxy phone smartphone tablet device new completely totally
suddenly whenever always again still just really even never ever goes go went going time short long work works working
use using try tried happen happens thing things anything nothing something other normal normally""".split()
NAME_TAIL = "the a an and or to your of on for".split()
DESCRIPTION_DROP = "and or for to of on in at by with via the a an your".split()
DESCRIPTION_TAIL = [*DESCRIPTION_DROP, "but", "is", "are", "doesn't", "on"]
TOPIC_DROP = "when while if using with the a an your my on in for to".split()
AUXILIARIES = "does do did is are not won't doesn't can't or and".split()
INDEX_STOPWORDS = "a an the and or of to for on in at by with via your you it its this that is are be from".split()
NAME_STOPWORDS = "the a an and or of to for on in with your my menu option options page".split()
TARGET_TAIL = "and or then to the a an it its once now next again".split()
PLACEHOLDER_TAIL = [*TARGET_TAIL, "or", "and", "with", "for", "in", "on"]
GENERIC_TARGETS = [
    "settings", "setting", "it", "them", "this", "that", "the screen", "screen", "device", "phone", "tablet", "app", "apps", "restart", "power", "back",
    "home", "ok", "done", "search field", "the search field", "top", "the top", "down", "up", "home screen", "apps screen", "allow", "yes", "no", "cancel",
    "start", "start now", "confirm", "next", "continue", "accept", "agree", "save", "apply", "delete", "delete all", "reset", "more", "more options", "add",
    "edit", "mirror", "remove", "uninstall", "install", "update", "search",
]
PLACEHOLDER_GENERIC = "settings setting screen device phone app apps".split()
