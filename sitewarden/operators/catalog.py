"""Every code that can be emitted: what was found, and what to do about it."""

_V = {"lcp": "Largest contentful paint", "fcp": "First contentful paint", "cls": "Cumulative layout shift", "tbt": "Total blocking time", "ttfb": "Time to first byte"}

CATALOG: dict[str, tuple[str, str]] = {
    # titles, descriptions and other head content
    "seo-missing-title": ("The page has no title", "Write a title that names the page's subject"),
    "seo-short-title": ("The title is very short", "Say more about the page in the title"),
    "seo-long-title": ("The title may be cut in results", "Shorten the title to 60 characters"),
    "seo-missing-meta-description": ("No meta description", "Summarise the page in a description"),
    "seo-short-meta-description": ("The meta description is short", "Use 50 to 160 characters"),
    "seo-long-meta-description": ("The meta description is long", "Use 50 to 160 characters"),
    "seo-meta-noindex": ("A meta tag keeps the page out of the index", "Drop noindex if the page should be found"),
    "seo-meta-nofollow": ("A meta tag keeps links from being followed", "Drop nofollow unless it is meant"),
    "seo-x-robots-noindex": ("A response header keeps the page out of the index", "Drop noindex from X-Robots-Tag"),
    "seo-x-robots-nofollow": ("A response header keeps links from being followed", "Drop nofollow from X-Robots-Tag"),
    "seo-meta-refresh": ("The page refreshes or redirects by meta tag", "Redirect with a status code instead"),
    "seo-multiple-canonical": ("Several canonical links", "Keep one canonical link"),
    "seo-missing-canonical": ("No canonical link", "Add a canonical link"),
    "seo-missing-h1": ("No first-level heading", "Add one h1"),
    "seo-multiple-h1": ("Several first-level headings", "Keep one h1"),
    "seo-empty-heading": ("A heading without text", "Fill or remove the heading"),
    "seo-skipped-heading-level": ("Heading levels are skipped", "Nest headings one level at a time"),
    "seo-missing-lang": ("The html element names no language", "Set the lang attribute"),
    "seo-missing-viewport": ("No viewport meta tag", "Add a viewport for small screens"),
    "seo-missing-charset": ("No declared character set", "Declare UTF-8 in the head"),
    "seo-missing-opengraph": ("No Open Graph tags", "Add og: tags for sharing"),
    # transport
    "http-redirect-loop": ("Redirects run in a circle", "Break the circle"),
    "http-redirect-chain": ("Several redirects in a row", "Point at the final URL"),
    "http-redirect": ("The URL redirects", "Link to the target"),
    "http-fetch-error": ("The URL could not be fetched", "Check the server and the link"),
    "http-server-error": ("The server failed", "Look into the server's log"),
    "http-client-error": ("The URL is not available", "Restore the page or drop the link"),
    "http-body-truncated": ("The body was cut at the size limit", "Make the page smaller"),
    "http-slow-response": ("The response took over two seconds", "Speed up the server or cache"),
    "http-mixed-content": ("A secure page loads insecure resources", "Load them over https"),
    # images, URLs, security headers
    "img-missing-alt": ("Images without alternative text", "Describe the images, or use an empty alt"),
    "img-missing-dimensions": ("Images without width or height", "Set both to avoid layout shifts"),
    "url-uppercase": ("Upper case in the path", "Use lower case"),
    "url-underscore": ("Underscores in the path", "Use hyphens"),
    "url-non-ascii": ("Characters beyond ASCII in the URL", "Use plain or escaped characters"),
    "url-too-long": ("A very long URL", "Shorten the path"),
    "security-missing-hsts": ("No Strict-Transport-Security", "Send the header"),
    "security-missing-csp": ("No Content-Security-Policy", "Send a policy"),
    "security-missing-x-content-type-options": ("Content types may be sniffed", "Send nosniff"),
    "security-insecure-form": ("A form sends data without encryption", "Post to https"),
    # speed
    "perf-cwv-not-collected": ("Web vitals were not collected", "Crawl with rendering"),
    "perf-response-time": ("Response time of the page", "For information"),
    "perf-cwv-render-failed": ("The page could not be rendered", "See the note"),
    "perf-render-incomplete": ("The rendered page lacks much of the raw one", "Check what scripts remove"),
    "perf-cwv-measured": ("Web vitals were measured", "For information"),
    **{f"perf-{k}-needs-improvement": (f"{v} could be better", "Compare with the threshold") for k, v in _V.items()},
    **{f"perf-{k}-poor": (f"{v} is poor", "Work on this first") for k, v in _V.items()},
    # walls and tags
    "botwall-challenge": ("A challenge page came instead of the content", "Allow the crawler, then crawl again"),
    "botwall-captcha-widget": ("The page embeds a captcha", "For information"),
    "tracking-none": ("No known tag", "Check that measuring is meant to be absent"),
    "tracking-duplicate-tag": ("One tag with several ids", "Keep the right id"),
    "tracking-tags": ("Known tags", "For information"),
    "tracking-mixed-ga-versions": ("Old and new analytics side by side", "Remove the old one"),
    # structured data
    "structured-invalid-jsonld": ("A JSON-LD block can't be parsed", "Fix its syntax"),
    "structured-missing-required": ("A typed object lacks required fields", "Add the fields"),
    "structured-breadcrumb-candidate": ("Breadcrumbs without markup", "Add BreadcrumbList"),
    "structured-product-candidate": ("A product without markup", "Add Product"),
    "structured-article-candidate": ("An article without markup", "Add Article"),
    "structured-video-candidate": ("A video without markup", "Add VideoObject"),
    "structured-none": ("No structured data", "Add what fits the page"),
    "structured-data": ("Structured data types", "For information"),
    # answer engines
    "aeo-answer-schema": ("Markup that answer engines read", "For information"),
    "aeo-answer-too-long": ("A long answer to a heading's question", "Answer in 60 words first"),
    "aeo-faq-candidate": ("Several questions without markup", "Add FAQPage"),
    "aeo-no-answer-lead": ("The page doesn't open with its answer", "Lead with a short answer"),
    "aeo-no-list-format": ("Long content without lists or tables", "Break it up"),
    "geo-ai-crawler-blocked": ("AI crawlers are shut out", "Decide whether that is meant"),
    "geo-llms-txt": ("llms.txt is there", "For information"),
    "geo-no-llms-txt": ("No llms.txt", "Consider adding one"),
    "geo-missing-author": ("Editorial content without author", "Name the author"),
    "geo-missing-date": ("Editorial content without date", "Give a date"),
    "geo-no-main-landmark": ("Long prose outside main and article", "Mark the main content"),
    "geo-js-dependent-content": ("Much of the text needs scripts", "Send the text in the HTML"),
    "geo-low-quotable-density": ("Few data points to quote", "Add figures"),
    # links
    "link-broken": ("A link to a page that fails", "Fix or remove the link"),
    "link-to-redirect": ("A link to a redirect", "Link to its target"),
    "link-empty-anchor": ("Links without text", "Name what they lead to"),
    "link-summary": ("Links of the page", "For information"),
    "link-inbound": ("Links to the page", "For information"),
    "pagination-detected": ("The page is part of a series", "For information"),
    "pagination-broken": ("A series link leads nowhere", "Fix the series"),
    "hreflang-invalid-code": ("An alternate's language code is invalid", "Use a BCP 47 code"),
    "hreflang-missing-x-default": ("Alternates without x-default", "Add a default"),
    "hreflang-missing-self": ("Alternates don't include the page", "Add the page itself"),
    "hreflang-no-return-link": ("An alternate doesn't link back", "Link both ways"),
    "amp-detected": ("An AMP page", "For information"),
    "amp-missing-canonical": ("AMP without canonical link", "Add the link"),
    "amp-missing-runtime": ("AMP without its runtime", "Load the runtime"),
    "amp-broken-amphtml": ("The AMP version fails", "Fix the link"),
    "amp-amphtml-linked": ("The page has an AMP version", "For information"),
    # content
    "duplicate-content": ("The same text on several pages", "Merge them or set a canonical"),
    "duplicate-title": ("The same title on several pages", "Tell the pages apart"),
    "duplicate-meta-description": ("The same description on several pages", "Tell the pages apart"),
    "content-thin": ("Very little text", "Add content or remove the page"),
    "content-low": ("Much less text than other pages", "Add content"),
    # sites
    "wp-detected": ("WordPress was detected", "For information"),
    "wp-version-exposed": ("The WordPress version is shown", "Hide it"),
    "wp-emoji-enabled": ("The emoji script is loaded", "Turn it off"),
    "wp-jquery-migrate": ("jquery-migrate is loaded", "Update what needs it"),
    "wp-many-plugin-assets": ("Many plugins load assets", "Reduce them"),
    "wp-default-tagline": ("The default tagline is in place", "Write your own"),
    "wp-no-seo-plugin": ("No SEO plugin seen", "Consider one"),
    "wp-multiple-seo-plugins": ("Several SEO plugins", "Keep one"),
    "wp-multilingual-detected": ("A multilingual plugin", "For information"),
    "wp-i18n-no-hreflang": ("Multilingual, yet no alternates", "Add hreflang"),
    "wp-ugly-permalink": ("A plain permalink", "Use readable permalinks"),
    "wp-i18n-lang-query-param": ("Language chosen by query", "Use paths or hosts"),
    "wp-html-lang-mismatch": ("The page's language isn't the one asked for", "Set lang rightly"),
    "wp-acf-leaked-markup": ("Template markup shows in the text", "Fix the template"),
    "wp-indexable-attachment": ("An attachment page is indexable", "Redirect or noindex it"),
    "wp-indexable-search": ("Search results are indexable", "Noindex them"),
    "wp-indexable-author-archive": ("An author archive is indexable", "Noindex it if it repeats"),
    "wp-indexable-date-archive": ("A date archive is indexable", "Noindex it"),
    "wp-xmlrpc-enabled": ("XML-RPC answers", "Turn it off"),
    "wp-user-enumeration-rest": ("REST lists users", "Restrict the endpoint"),
    "wp-user-enumeration-author": ("Author ids reveal logins", "Stop the redirect"),
    "wp-directory-listing": ("Uploads can be listed", "Turn listing off"),
    "wp-readme-exposed": ("readme.html is reachable", "Remove it"),
    "robots-missing": ("No robots.txt", "Add one"),
    "robots-no-sitemap-declared": ("robots.txt names no sitemap", "Add a Sitemap line"),
    "robots-sitemaps-declared": ("robots.txt names sitemaps", "For information"),
    "robots-crawled-disallowed": ("A crawled page is disallowed", "Check the rule"),
    "sitemap-invalid": ("A declared sitemap can't be read", "Fix the file"),
    "sitemap-truncated": ("A declared sitemap was cut", "Split the file"),
    "sitemap-missing": ("No sitemap found", "Add one"),
    "sitemap-coverage": ("How sitemap and crawl compare", "For information"),
    # campaigns
    "utm-internal-tagged": ("An internal link carries campaign tags", "Drop the tags"),
    "utm-partial-tagging": ("Campaign tags are incomplete", "Set source, medium and campaign"),
    "utm-empty-value": ("A campaign tag is empty", "Fill it"),
    "utm-duplicate-param": ("A campaign tag is repeated", "Keep one"),
    "utm-inconsistent-casing": ("Campaign tags in mixed case", "Use lower case"),
    "utm-summary": ("Campaign tagging of the page's links", "For information"),
    "landing-not-https": ("A landing page without encryption", "Serve it over https"),
    "landing-noindex": ("A landing page is kept out of the index", "Check that this is meant"),
    "landing-missing-title": ("A landing page without title", "Add a title"),
    "landing-missing-h1": ("A landing page without h1", "Add an h1"),
    "landing-missing-description": ("A landing page without description", "Add one"),
    "landing-keyword-mismatch": ("The page hardly speaks of the campaign's terms", "Align both"),
    "landing-keyword-weak": ("The page speaks of few of the campaign's terms", "Align both"),
    "landing-keyword-aligned": ("The page matches the campaign's terms", "For information"),
    "datalayer-not-collected": ("The data layer was not collected", "Crawl with rendering"),
    "datalayer-gtm-noscript-missing": ("The container has no noscript part", "Add it"),
    "datalayer-gtm-snippet-not-in-head": ("The container isn't in the head", "Move it up"),
    "datalayer-push-before-init": ("Pushes come before the data layer exists", "Initialise first"),
    "datalayer-init-missing": ("Tags without a data layer", "Initialise it"),
    "datalayer-gtag-config-id-mismatch": ("A configured id is never loaded", "Load it or drop it"),
    "datalayer-consent-mode-present": ("Consent mode is used", "For information"),
    "datalayer-consent-mode-missing": ("Tags without consent mode", "Set a default"),
    "datalayer-empty": ("The data layer is empty", "Check the container"),
    "datalayer-events": ("Events of the data layer", "For information"),
    "datalayer-page-view-missing": ("No page view was pushed", "Push one"),
    "datalayer-ecommerce-event-invalid": ("A shop event lacks parameters", "Add them"),
    "datalayer-param-type": ("A parameter has the wrong type", "Fix its type"),
    "datalayer-duplicate-event": ("A conversion fires more than once", "Fire it once"),
    "datalayer-duplicate-transaction": ("A transaction is reported twice", "Report it once"),
    "datalayer-pii": ("Personal data in the data layer", "Remove it"),
    "datalayer-tag-not-firing": ("A tag sends nothing", "Check consent and setup"),
    "datalayer-tags-firing": ("Tags that send data", "For information"),
}

#: Why findings of a kind matter, by the first word of their code.
IMPACT: dict[str, str] = {
    "seo": "Search engines show, rank or leave out the page by what its head says",
    "http": "Visitors and crawlers wait, are sent around or get no page",
    "link": "Links that lead nowhere waste visits, and pages without links are hardly found",
    "img": "Without texts and sizes pictures can't be read aloud and pages jump while they load",
    "url": "Addresses that are hard to type and share are linked less and split into variants",
    "security": "Browsers protect visitors only where the headers ask for it",
    "perf": "Slow or jumping pages lose visitors and rank lower",
    "botwall": "What is behind the wall was not seen, so other findings are incomplete",
    "tracking": "Missing or doubled tags make visits look fewer or more than they are",
    "structured": "Rich results need data that machines can read",
    "aeo": "Answer engines quote pages that answer in short, marked-up passages",
    "geo": "Generative engines cite pages that they may read and can attribute",
    "pagination": "Broken series hide what comes after the first page",
    "hreflang": "Visitors land on a page in the wrong language",
    "amp": "A pair of pages that doesn't agree is shown in one form only",
    "duplicate": "Pages that say the same compete with each other",
    "content": "Pages with little of their own are rarely shown",
    "wp": "Known traces of the system help attackers and clutter the index",
    "robots": "Crawlers follow this file before anything else",
    "sitemap": "Pages that no sitemap lists are found late",
    "utm": "Visits are credited to the wrong campaign",
    "landing": "Paid visits cost more where the page doesn't match its advertisement",
    "datalayer": "Reports are built on what the data layer says",
}


#: Why a finding matters by itself, where its family says too little.
OWN_IMPACT: dict[str, str] = {
    "seo-missing-title": "Results show a title that the search engine makes up",
    "seo-short-title": "A title of a word or two seldom says what is searched for",
    "seo-long-title": "The end of the title is cut off in results",
    "seo-missing-meta-description": "Results quote some sentence of the page instead",
    "seo-short-meta-description": "The space below the title in results stays unused",
    "seo-long-meta-description": "The end of the description is cut off in results",
    "seo-meta-noindex": "The page will not be found by search",
    "seo-meta-nofollow": "What the page links to gets no credit from it",
    "seo-x-robots-noindex": "The page will not be found by search, though its HTML doesn't say so",
    "seo-x-robots-nofollow": "What the page links to gets no credit from it, though its HTML doesn't say so",
    "seo-meta-refresh": "Visitors lose their place, and the back button leads in a circle",
    "seo-multiple-canonical": "Search engines ignore all of them",
    "seo-missing-canonical": "Variants of the address are indexed as pages of their own",
    "seo-missing-h1": "Readers and machines can't tell the subject at a glance",
    "seo-multiple-h1": "The subject of the page is unclear",
    "seo-empty-heading": "Screen readers announce a heading and nothing after it",
    "seo-skipped-heading-level": "The outline that screen readers offer has a gap",
    "seo-missing-lang": "Screen readers may read the page in the wrong language",
    "seo-missing-viewport": "Phones show the page as a small picture of a wide one",
    "seo-missing-charset": "Letters may come out wrong",
    "seo-missing-opengraph": "Shared links have no picture and a title of chance",
    "http-redirect-loop": "Nobody ever gets the page",
    "http-redirect-chain": "Each hop costs time, and crawlers give up after some",
    "http-redirect": "Links to it cost a request more than they need",
    "http-fetch-error": "Whoever asks for the page gets nothing",
    "http-server-error": "The page is down, and leaves the index if it stays so",
    "http-client-error": "Visitors meet an error where a page was promised",
    "http-body-truncated": "What comes after the cut was not judged",
    "http-slow-response": "Visitors leave, and crawlers ask for fewer pages",
    "http-mixed-content": "Browsers block what is loaded without encryption",
    "link-broken": "Visitors meet an error, and what the link passes on is lost",
    "link-to-redirect": "Each visit and each crawl costs a request more",
    "link-empty-anchor": "Screen readers read the address, and engines learn nothing about the target",
    "link-inbound": "Pages that few others link to are found late and rank low",
    "img-missing-alt": "Who can't see the picture doesn't learn what it shows",
    "img-missing-dimensions": "The page jumps while pictures load",
    "security-missing-hsts": "The first request of a visit can be read and changed on its way",
    "security-missing-csp": "A script that is slipped in runs with the page's rights",
    "security-missing-x-content-type-options": "A file may be run as something that it isn't",
    "security-insecure-form": "What visitors type is sent in the clear",
    "structured-invalid-jsonld": "The block is ignored as a whole",
    "structured-missing-required": "No rich result is made of the entry",
    "aeo-answer-too-long": "Answers of more than 60 words are seldom quoted",
    "aeo-faq-candidate": "The page asks and answers, but machines can't tell",
    "geo-ai-crawler-blocked": "The named services can't cite the site",
    "geo-js-dependent-content": "Crawlers that run no scripts see little of the page",
    "hreflang-no-return-link": "Alternates that don't point back are ignored",
    "hreflang-invalid-code": "The alternate is ignored",
    "pagination-broken": "The series ends here for crawlers",
    "duplicate-content": "One of the pages is shown, and not always the one that is meant",
    "content-thin": "A page of so few words is rarely shown",
    "robots-crawled-disallowed": "The file shuts out what links lead to",
    "sitemap-invalid": "The whole file is ignored",
    "utm-internal-tagged": "The visit is credited to the site itself, and where it came from is lost",
    "landing-noindex": "Advertised pages that are kept out of the index earn no free visits",
    "datalayer-pii": "Personal data reaches analytics, against its terms and the law",
    "datalayer-duplicate-transaction": "Revenue is counted twice",
}


def explain(code: str) -> dict[str, str]:
    """What was found, why it matters and what to do."""
    what, fix = CATALOG[code]
    return {"what": what, "impact": OWN_IMPACT.get(code, IMPACT[code.split("-")[0]]), "fix": fix}
