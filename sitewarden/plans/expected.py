"""The issues of the fixture crawl: analyzer, code, severity, URL. Fixed values, recorded from a run and reviewed against the rules."""

EXPECTED: list[tuple[str, str, str, str]] = [
    ("redirects", "http-client-error", "error", "https://shop.example/gone"),
    ("redirects", "http-client-error", "error", "https://shop.example/wall"),
    ("redirects", "http-fetch-error", "error", "https://shop.example/err"),
    ("redirects", "http-mixed-content", "warning", "https://shop.example/"),
    ("redirects", "http-redirect", "info", "https://shop.example/old"),
    ("redirects", "http-redirect-loop", "error", "https://shop.example/loop"),
    ("redirects", "http-server-error", "error", "https://shop.example/server"),
    ("redirects", "http-slow-response", "warning", "https://shop.example/"),
    ("links", "link-broken", "error", "https://shop.example/"),
    ("links", "link-empty-anchor", "info", "https://shop.example/"),
    ("links", "link-inbound", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("links", "link-inbound", "info", "https://shop.example/"),
    ("links", "link-inbound", "info", "https://shop.example/?p=7&lang=fr"),
    ("links", "link-inbound", "info", "https://shop.example/amp"),
    ("links", "link-inbound", "info", "https://shop.example/author/ann/"),
    ("links", "link-inbound", "info", "https://shop.example/de"),
    ("links", "link-inbound", "info", "https://shop.example/en"),
    ("links", "link-inbound", "info", "https://shop.example/form"),
    ("links", "link-inbound", "info", "https://shop.example/gtm"),
    ("links", "link-inbound", "info", "https://shop.example/new"),
    ("links", "link-inbound", "info", "https://shop.example/tags"),
    ("links", "link-summary", "info", "https://shop.example/"),
    ("links", "link-summary", "info", "https://shop.example/form"),
    ("links", "link-to-redirect", "warning", "https://shop.example/"),
    ("seo", "seo-empty-heading", "warning", "https://shop.example/new"),
    ("seo", "seo-meta-nofollow", "info", "https://shop.example/new"),
    ("seo", "seo-meta-noindex", "warning", "https://shop.example/new"),
    ("seo", "seo-missing-canonical", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/?p=7&lang=fr"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/amp"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/author/ann/"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/de"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/en"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/form"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/gtm"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/new"),
    ("seo", "seo-missing-canonical", "info", "https://shop.example/tags"),
    ("seo", "seo-skipped-heading-level", "info", "https://shop.example/new"),
    ("robots", "robots-crawled-disallowed", "warning", "https://shop.example/gone"),
    ("robots", "robots-missing", "info", "host down.example"),
    ("robots", "robots-missing", "info", "host none.example"),
    ("robots", "robots-no-sitemap-declared", "info", "host bare.example"),
    ("robots", "robots-sitemaps-declared", "info", "host shop.example"),
    ("sitemap", "sitemap-coverage", "info", "https://shop.example/"),
    ("sitemap", "sitemap-invalid", "warning", "https://shop.example/broken.xml"),
    ("structured", "structured-article-candidate", "warning", "https://shop.example/de"),
    ("structured", "structured-breadcrumb-candidate", "warning", "https://shop.example/form"),
    ("structured", "structured-data", "info", "https://shop.example/de"),
    ("structured", "structured-invalid-jsonld", "warning", "https://shop.example/form"),
    ("structured", "structured-missing-required", "warning", "https://shop.example/de"),
    ("structured", "structured-missing-required", "warning", "https://shop.example/de"),
    ("structured", "structured-none", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("structured", "structured-none", "info", "https://shop.example/"),
    ("structured", "structured-none", "info", "https://shop.example/?p=7&lang=fr"),
    ("structured", "structured-none", "info", "https://shop.example/amp"),
    ("structured", "structured-none", "info", "https://shop.example/author/ann/"),
    ("structured", "structured-none", "info", "https://shop.example/en"),
    ("structured", "structured-none", "info", "https://shop.example/gtm"),
    ("structured", "structured-none", "info", "https://shop.example/new"),
    ("structured", "structured-none", "info", "https://shop.example/tags"),
    ("structured", "structured-video-candidate", "warning", "https://shop.example/form"),
    ("duplicates", "duplicate-meta-description", "info", "https://shop.example/"),
    ("duplicates", "duplicate-meta-description", "info", "https://shop.example/new"),
    ("duplicates", "duplicate-title", "warning", "https://shop.example/"),
    ("duplicates", "duplicate-title", "warning", "https://shop.example/new"),
    ("content", "content-thin", "warning", "https://shop.example/gtm"),
    ("images", "img-missing-alt", "warning", "https://shop.example/"),
    ("images", "img-missing-dimensions", "info", "https://shop.example/"),
    ("security", "security-insecure-form", "warning", "https://shop.example/"),
    ("security", "security-missing-csp", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("security", "security-missing-csp", "info", "https://shop.example/new"),
    ("security", "security-missing-hsts", "warning", "https://shop.example/new"),
    ("security", "security-missing-x-content-type-options", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("security", "security-missing-x-content-type-options", "info", "https://shop.example/new"),
    ("urls", "url-underscore", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("urls", "url-uppercase", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("hreflang", "hreflang-invalid-code", "warning", "https://shop.example/de"),
    ("hreflang", "hreflang-missing-self", "info", "https://shop.example/de"),
    ("hreflang", "hreflang-missing-x-default", "info", "https://shop.example/de"),
    ("hreflang", "hreflang-missing-x-default", "info", "https://shop.example/en"),
    ("hreflang", "hreflang-no-return-link", "warning", "https://shop.example/en"),
    ("pagination", "pagination-broken", "warning", "https://shop.example/"),
    ("pagination", "pagination-detected", "info", "https://shop.example/"),
    ("amp", "amp-amphtml-linked", "info", "https://shop.example/"),
    ("amp", "amp-detected", "info", "https://shop.example/amp"),
    ("amp", "amp-missing-canonical", "warning", "https://shop.example/amp"),
    ("amp", "amp-missing-runtime", "error", "https://shop.example/amp"),
    ("perf", "perf-cls-poor", "error", "https://shop.example/tags"),
    ("perf", "perf-cwv-measured", "info", "https://shop.example/tags"),
    ("perf", "perf-fcp-poor", "error", "https://shop.example/tags"),
    ("perf", "perf-lcp-needs-improvement", "warning", "https://shop.example/tags"),
    ("perf", "perf-ttfb-needs-improvement", "warning", "https://shop.example/tags"),
    ("tracking", "tracking-duplicate-tag", "warning", "https://shop.example/gtm"),
    ("tracking", "tracking-mixed-ga-versions", "info", "https://shop.example/gtm"),
    ("tracking", "tracking-none", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("tracking", "tracking-none", "info", "https://shop.example/"),
    ("tracking", "tracking-none", "info", "https://shop.example/?p=7&lang=fr"),
    ("tracking", "tracking-none", "info", "https://shop.example/amp"),
    ("tracking", "tracking-none", "info", "https://shop.example/author/ann/"),
    ("tracking", "tracking-none", "info", "https://shop.example/de"),
    ("tracking", "tracking-none", "info", "https://shop.example/en"),
    ("tracking", "tracking-none", "info", "https://shop.example/form"),
    ("tracking", "tracking-none", "info", "https://shop.example/new"),
    ("tracking", "tracking-tags", "info", "https://shop.example/gtm"),
    ("tracking", "tracking-tags", "info", "https://shop.example/tags"),
    ("datalayer", "datalayer-consent-mode-missing", "info", "https://shop.example/gtm"),
    ("datalayer", "datalayer-consent-mode-present", "info", "https://shop.example/tags"),
    ("datalayer", "datalayer-duplicate-event", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-duplicate-transaction", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-events", "info", "https://shop.example/tags"),
    ("datalayer", "datalayer-gtag-config-id-mismatch", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-gtm-noscript-missing", "warning", "https://shop.example/gtm"),
    ("datalayer", "datalayer-gtm-snippet-not-in-head", "info", "https://shop.example/gtm"),
    ("datalayer", "datalayer-init-missing", "warning", "https://shop.example/gtm"),
    ("datalayer", "datalayer-param-type", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-param-type", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-param-type", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-pii", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-push-before-init", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-tag-not-firing", "warning", "https://shop.example/tags"),
    ("datalayer", "datalayer-tags-firing", "info", "https://shop.example/tags"),
    ("utm", "utm-duplicate-param", "warning", "https://shop.example/"),
    ("utm", "utm-empty-value", "warning", "https://shop.example/"),
    ("utm", "utm-inconsistent-casing", "info", "https://shop.example/"),
    ("utm", "utm-internal-tagged", "info", "https://shop.example/"),
    ("utm", "utm-partial-tagging", "warning", "https://shop.example/"),
    ("utm", "utm-summary", "info", "https://shop.example/"),
    ("utm", "utm-summary", "info", "https://shop.example/form"),
    ("landing", "landing-keyword-aligned", "info", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("landing", "landing-not-https", "warning", "http://shop.example/Sale_Page?utm_term=red+shoes&utm_campaign=summer"),
    ("botwall", "botwall-captcha-widget", "info", "https://shop.example/form"),
    ("botwall", "botwall-challenge", "warning", "https://shop.example/wall"),
    ("wordpress", "wp-acf-leaked-markup", "warning", "https://shop.example/?p=7&lang=fr"),
    ("wordpress", "wp-detected", "info", "https://shop.example/"),
    ("wordpress", "wp-html-lang-mismatch", "warning", "https://shop.example/?p=7&lang=fr"),
    ("wordpress", "wp-i18n-lang-query-param", "info", "https://shop.example/?p=7&lang=fr"),
    ("wordpress", "wp-indexable-author-archive", "info", "https://shop.example/author/ann/"),
    ("wordpress", "wp-multilingual-detected", "info", "https://shop.example/"),
    ("wordpress", "wp-no-seo-plugin", "info", "https://shop.example/"),
    ("wordpress", "wp-ugly-permalink", "info", "https://shop.example/?p=7&lang=fr"),
    ("wordpress", "wp-version-exposed", "warning", "https://shop.example/"),
    ("aeo", "aeo-answer-too-long", "info", "https://shop.example/en"),
    ("aeo", "aeo-answer-too-long", "info", "https://shop.example/en"),
    ("aeo", "aeo-faq-candidate", "warning", "https://shop.example/en"),
    ("aeo", "aeo-no-answer-lead", "info", "https://shop.example/en"),
    ("aeo", "aeo-no-list-format", "info", "https://shop.example/en"),
    ("geo", "geo-ai-crawler-blocked", "info", "host shop.example"),
    ("geo", "geo-low-quotable-density", "info", "https://shop.example/form"),
    ("geo", "geo-missing-author", "info", "https://shop.example/de"),
    ("geo", "geo-no-main-landmark", "info", "https://shop.example/form"),
]
