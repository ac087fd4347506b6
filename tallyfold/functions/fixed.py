"""Fixed values that results depend on: families, half-lives, weights, stop lists and term lists."""

from math import log10

# Half-life in days of each signal family, and its weight in the composite.
HALF_LIFE = {"capital": 45.0, "regulatory": 60.0, "research": 45.0, "hiring": 30.0, "traffic": 30.0, "github": 21.0, "launch": 21.0, "social": 14.0}
OTHER_HALF_LIFE = 21.0
WEIGHT = {"capital": 0.20, "regulatory": 0.16, "github": 0.15, "research": 0.14, "hiring": 0.14, "launch": 0.09, "social": 0.06, "traffic": 0.06}
FAMILIES = list(WEIGHT)
FAMILY_GAIN, FAMILY_CAP = 4.2, 0.70
#: A family counts as firing from this strength on; a live signal counts from this one.
FIRING, LIVE = 0.12, 0.005
UNCORROBORATED = 0.85
STAGE_CONSENSUS = {"early": 0.2, "growth": 0.6, "incumbent": 0.9}
FOOTPRINT = ["hn_mentions_total", "tranco_rank", "stars_total", "open_roles", "team_size"]
UNMEASURED = 0.2
TRAFFIC_TIERS = [(100_000, 0.85), (400_000, 0.5), (1_000_000, 0.25), (2_000_000, 0.08)]

# Hosts that are never a company's own (shared platforms), and suffixes that are no company's.
GENERIC_HOSTS = """
github.com github.io gitlab.com gitlab.io codeberg.org bitbucket.org linkedin.com twitter.com x.com youtube.com youtu.be
medium.com substack.com notion.site notion.so google.com arxiv.org huggingface.co hf.space facebook.com instagram.com
tiktok.com linktr.ee bit.ly t.co discord.gg discord.com readthedocs.io vercel.app netlify.app herokuapp.com railway.app
pages.dev workers.dev fly.dev onrender.com web.app firebaseapp.com streamlit.app replit.app wordpress.com wixsite.com
squarespace.com webflow.io framer.website carrd.co gmail.com outlook.com yahoo.com proton.me pypi.org npmjs.com crates.io
apple.com ycombinator.com producthunt.com t.me bsky.app itch.io arduino.cc hackaday.io hackaday.com hackster.io
kickstarter.com indiegogo.com crunchbase.com wellfound.com angel.co workatastartup.com ashbyhq.com greenhouse.io lever.co
workable.com rippling.com gem.com dover.com breezy.hr bamboohr.com applytojob.com recruitee.com teamtailor.com
pinpointhq.com personio.de personio.com smartrecruiters.com a16z.com sosv.com hax.co sec.gov fcc.gov faa.gov nrc.gov
uspto.gov wikipedia.org reddit.com amazon.com amzn.to calendly.com typeform.com airtable.com loom.com vimeo.com figma.com
dropbox.com zoom.us
""".split()
NON_COMPANY_SUFFIXES = ".edu .gov .mil .ac.uk .edu.cn .ac.jp .ac.kr .edu.au .gov.sg .edu.sg .ac.nz .gov.uk .gc.ca .ac.in .edu.hk .ac.cn".split()

# Trailing legal forms (any case, and in capitals only), and trailing words that describe.
LEGAL = r"inc|incorporated|llc|l\.l\.c|corp|corporation|ltd|limited|gmbh|plc|pbc|lp|llp|s\.r\.l|srl|b\.v|co\.?,?\s+ltd"
LEGAL_CAPITALS = r"SA|S\.A\.|AB|AG|BV|OY|KK|SAS|PTE|PTY|USA|OÜ|NV|SE"
DESCRIPTIVE = r"\s+(technologies|technology|labs|lab|systems|ai|robotics|industries|aerospace|dynamics|energy|defense|space|group|holdings)$"
# Fixed value: query parameters that only track.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid"]
# Fixed value: date formats of public sources, most exact first.
DATE_FORMATS = [
    "yyyy-M-d'T'H:m:s'Z'", "yyyy-M-d'T'H:m:s.SSSSSS'Z'", "yyyy-M-d", "M/d/yyyy", "yyyyMMdd",
    "MMMM d, yyyy", "MMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "M-d-yyyy",
]

# What each source's kinds of signal are worth.
SBIR_FIRST, SBIR_UNCLEAR, SBIR_REPEAT = 0.70, 0.42, [(2, 0.50), (9, 0.40), (24, 0.28)]
SBIR_MANY, SBIR_TEAM, SBIR_ONE_KEYWORD = 0.18, [(10, 0.08), (50, 0.02), (250, -0.10)], 0.465
SBIR_LARGE_TEAM, SBIR_LARGE_REPEAT, SBIR_ORDER = -0.22, -0.03, -0.05
NSF_BASE, NSF_FAST_TRACK, NSF_FIRST, NSF_REPEAT = 0.38, 0.15, 0.07, -0.10
ARPA_BASE = {"announced earlier": 0.35, "selected": 0.45, "started": 0.40}
ARPA_SIZE, ARPA_HALF, ARPA_FIRST, ARPA_FIRST_EARLIER, ARPA_REPEAT = 0.25, 3_000_000, 0.20, 0.10, -0.10
WAIVER_BOTH, WAIVER_SIGHT, WAIVER_MANY, WAIVER_OTHER = 0.56, 0.45, 0.40, 0.27
TRADEMARK_SCOPE = {"goods": 0.15, "related": 0.09, "software": 0.05, "services": 0.0}
LAUNCH_HALF, LAUNCH_BONUS, LAUNCH_FLOOR, FIRST_STORY, FIRST_STORY_POINTS = 60, 0.05, 0.40, 0.07, 20
GOVCLOUD = {"mail and dns": 0.40, "mail": 0.35, "dns": 0.30, "sender": 0.25}
YOUNG_DOMAIN = 0.05
REGISTERED, REGISTERED_PROJECT = 0.45, 0.35
BACK_FILLED = 0.3

# Days and shares of job boards, series, certificates and careers.
NEW_SHORT_DAYS, NEW_DAYS = 14, 30
PHYSICAL_FUNCTIONS = ["hardware", "controls_embedded", "manufacturing"]
BULK_WINDOW_DAYS, BULK_MIN_ROLES, BULK_SHARE = 3, 4, 0.5
SUSTAINED_WEEK, WEEKS_LOOKED_AT = 10, 8
FRESH_DAYS, RENEWAL_MARGIN = 30, 2
SOLID_YEARS, SHARED_YEARS, MOST_SOLID = 3, 2, 6
MOST_ALIASES = 12

# Moves and entries on a rank list.
COHORT_BAND, COHORT_MIN, COHORT_MAX = 1.5, 200, 4000
MATERIAL_SHARE, LEAST_RATIO = 0.9, {30: 1.2, 90: 1.3}
SUSTAINED_MOVE, STALE_WINDOW, MOST_MOVE = 0.06, 0.9, 0.9
MOVE_ANCHORS = [(1.0, 0.30), (1.3, 0.42), (2.0, 0.60), (3.0, 0.78), (4.0, 0.88)]
DEPTH_ANCHORS = [(1_000_000, 1.0), (2_000_000, 0.9), (3_000_000, 0.8), (4_000_000, 0.7)]
ENTRANT_RATES, ENTRANT_RATE_DEEP = [(100_000, 0.006), (1_000_000, 0.019), (2_000_000, 0.071), (3_500_000, 0.26)], 0.50
ENTRANT_ANCHORS = [(log10(0.005), 0.85), (log10(0.02), 0.70), (log10(0.07), 0.42), (log10(0.26), 0.22), (log10(0.50), 0.15)]
YOUTH_ANCHORS, UNDATED_ENTRY, MOST_ENTRANT = [(1.0, 0.85), (7.0, 1.0)], 0.9, 0.85

# What a filing for an experimental licence is worth.
FILING_STA, FILING_STA_PENDING, FILING_GRANTED, FILING_PENDING = 0.30, 0.40, 0.42, 0.55
FILING_SENIOR, FILING_UNITS, FILING_UNITS_HALF, FILING_SIGN = 0.12, 0.14, 40, 0.05
FILING_ONLY, FILING_SOME, FILING_MANY, FILING_ROUTINE, FILING_OFF_THESIS = 0.05, -0.04, -0.12, 0.22, 0.7
SENIOR_TITLE = r"(?i)\b(?:co-?founder|founder|ceo|cto|coo|owner|managing\s+director|chief\s+\w+\s+officer|chief\s+(?:engineer|scientist|technologist))\b|(?<!vice )(?<!vice-)\bpresident\b"

# Words that tell a company's name from a person's, and what business a name says.
ORG_WORD = r"(?i)\b(llc|l\.l\.c|inc|incorporated|corp|corporation|co|company|ltd|limited|lp|llp|pllc|pbc|group|partners|services|solutions|enterprises|associates|holdings)\b"
NAME_EXTRAS = ["jr", "sr", "ii", "iii", "iv"]
CUE_AVIATION = r"(?i)aero|aerial|avia|drone|\buas\b|uav|unmanned|uncrewed|robot|autonom|flight|fly|flite|sky|\bair|copter|rotor|hover|\bwing|defen[cs]e"
CUE_TECHNOLOGY = r"(?i)dynamics|technolog|\btech\b|\bsystems?\b|\blabs?\b|industries|intelligence|sensing|security|delivery|automation|radar"
CUE_AI = r"(?:\b|[a-z])AI\b"
SERVICE_NAME = r"(?i)\b(services?|solutions|aerials|on demand)\b"
GIVEN_NAMES = """
aaron adam alan albert alex alexander andrew andy anna anthony antonio austin barry ben benjamin
bill bob brad bradley brandon brent brian bruce bryan carl carlos chad charles chris christian
christopher cody craig dale dan daniel danny darren dave david dean dennis derek devon don donald
doug douglas dustin dylan edward eric erik ethan frank gary george gerald glenn greg gregory
harold henry jack jacob jake james jared jason jay jeff jeffrey jeremy jerry jesse jim jimmy joe
joel john johnny jon jonathan jordan jose joseph josh joshua juan justin karen keith kelly ken
kenneth kevin kyle larry lawrence lee linda lisa logan luis luke marc mark martin mary matt
matthew michael mike nathan nicholas nick nicky pat patrick paul peter phil philip phillip ralph
randy ray raymond richard rick rob robert rodney roger ron ronald roy russell ryan sam samuel
sarah scott sean shane shawn stephen steve steven susan ted terry thomas tim timothy todd tom
tommy tony travis trevor troy tyler victor vincent walter wayne william zach zachary
""".split()
