"""Signature tables and thresholds of the page rules. Fixed values throughout."""

#: Tag, family, lower-case signals, pattern of ids (group 1, if there is one, is the id).
TAGS = [
    ("Google Tag Manager", "", ["googletagmanager.com/gtm.js"], r"{B}GTM-[A-Z0-9]+"),
    ("GA4", "ga4", ["googletagmanager.com/gtag/js", "gtag/js?id=g-"], r"{B}G-[A-Z0-9]{{4,}}"),
    ("Universal Analytics", "ua", ["google-analytics.com/analytics.js", "google-analytics.com/ga.js"], r"{B}UA-\d+-\d+"),
    ("Google Ads", "", [], r"{B}AW-\d+"),
    ("Meta Pixel", "", ["connect.facebook.net", "fbq("], r"(?:facebook\.com/tr\?id=|fbq\(\s*['\"]init['\"]\s*,\s*['\"])(\d{{6,}})"),
    ("LinkedIn Insight", "", ["snap.licdn.com", "_linkedin_partner_id"], r"_linkedin_partner_id\s*=\s*[\"']?(\d+)"),
    ("Microsoft Bing UET", "", ["bat.bing.com/bat.js", "uetq"], ""),
    ("TikTok Pixel", "", ["analytics.tiktok.com", "ttq.load", "ttq.page"], ""),
]
#: Vendor, markers, whether a marker alone proves a challenge page.
WALLS = [
    ("Cloudflare", ["/cdn-cgi/challenge-platform/", "cf-browser-verification", "cf_chl_opt", "_cf_chl_", "window._cf_chl", "cf-mitigated"], True),
    ("AWS WAF", ["captcha.awswaf.com", "token.awswaf.com", "awswafintegration", "aws-waf-token"], True),
    ("DataDome", ["geo.captcha-delivery.com", "captcha-delivery.com", "datadome-captcha"], True),
    ("PerimeterX / HUMAN", ["px-captcha", "_pxcaptcha", "captcha.px-cdn.net"], True),
    ("Imperva Incapsula", ["_incapsula_resource", "incapsula incident", "subject=incident"], True),
    ("Cloudflare Turnstile", ["challenges.cloudflare.com/turnstile", "cf-turnstile", "turnstile/v0/"], False),
    ("Google reCAPTCHA", ["g-recaptcha", "google.com/recaptcha/", "gstatic.com/recaptcha/", "recaptcha/api.js", "grecaptcha.execute"], False),
    ("hCaptcha", ["h-captcha", "hcaptcha.com/1/", "js.hcaptcha.com"], False),
]
WALL_TITLES = [
    "just a moment", "attention required", "are you a robot", "are you human", "verify you are human", "access denied", "security check",
    "checking your browser", "one more step", "please verify",
]
WALL_STATUSES = [401, 403, 429, 503]
THIN_BYTES = 1200
#: Metric, good up to, needs improvement up to.
VITALS = [("lcp", 2500.0, 4000.0), ("fcp", 1800.0, 3000.0), ("cls", 0.1, 0.25), ("tbt", 200.0, 600.0), ("ttfb", 800.0, 1800.0)]
AI_AGENTS = [
    "GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "PerplexityBot", "Google-Extended", "Applebot-Extended",
    "CCBot", "Bytespider", "meta-externalagent",
]
SEO_PLUGINS = [("yoast", "Yoast SEO"), ("rank-math", "Rank Math"), ("rank math", "Rank Math"), ("aioseo", "All in One SEO"), ("all in one seo", "All in One SEO")]
I18N_PLUGINS = [("sitepress-multilingual-cms", "WPML"), ("wpml-ls", "WPML"), ("icl_", "WPML"), ("polylang", "Polylang"), ("translatepress", "TranslatePress"), ("weglot", "Weglot")]
PLUGIN_SLUG = "/wp-content/plugins/([a-zA-Z0-9._-]+)"
MANY_PLUGINS = 10
UTM_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
UTM_REQUIRED = ["utm_source", "utm_medium", "utm_campaign"]
CAMPAIGN_KEYS = ["utm_term", "utm_campaign", "utm_content"]
ECOMMERCE = {
    "purchase": ["transaction_id", "value", "currency", "items"],
    "refund": ["transaction_id", "currency"],
    "add_to_cart": ["currency", "value", "items"],
    "remove_from_cart": ["currency", "value", "items"],
    "begin_checkout": ["currency", "value", "items"],
    "add_payment_info": ["currency", "value", "items"],
    "view_item": ["currency", "value", "items"],
    "view_item_list": ["items"],
    "select_item": ["items"],
    "add_to_wishlist": ["currency", "value", "items"],
}
CONVERSIONS = ["purchase", "generate_lead", "sign_up", "conversion", "subscribe"]
PAGE_LOADS = ["page_view", "pageview", "gtm.js", "gtm.load", "gtm.dom"]
BEACONS = [
    ("GA4", ["/g/collect", "google-analytics.com/g/", "analytics.google.com/g/"]),
    ("Google Ads", ["googleadservices.com/pagead/conversion", "google.com/pagead", "googleads.g.doubleclick.net"]),
    ("Meta Pixel", ["facebook.com/tr"]),
    ("Google Tag Manager", ["googletagmanager.com/gtm.js"]),
]
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"\d[\d\s().-]{6,}\d"
#: Word borders of ASCII words: what ``\\b`` means differs between versions of the JVM.
PHONE_KEY = r"(?i)(?<![A-Za-z0-9_])(phone|tel|mobile|msisdn)(?![A-Za-z0-9_])"
VIDEO_HOSTS = r"(?i)youtube(-nocookie)?\.com|vimeo\.com"
README_VERSION = r"(?i)version\s+(\d+\.\d+(?:\.\d+)?)"
