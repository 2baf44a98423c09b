"""Labelled blocks from which the block classifier of html learns, written for this purpose. A bounded set: the lines below.

Each line has the label (1 main text, 0 not), the words of the block, the share of it that is link text, whether it ends as a
sentence does, and the elements around it, from the outermost. An element is tag.class1.class2; # is an id, @ a role.
"""

LABELLED = """
1 40 0 y body article p
1 25 0.1 y body article p
1 12 0 y body article p
1 4 0 y body article p
1 2 0 n body article p
1 8 0 n body article h1
1 5 0 n body article h2
1 30 0 y body article div
1 9 0 n body article ul li
1 20 0 y body article ul li
1 3 0 n body article ol li
1 6 1 n body article ul li
1 18 0.2 y body article blockquote p
1 14 0 n body article pre
1 7 0 n body article figure figcaption
1 4 0 n body article table tr td
1 3 0 n body article table tr th
1 10 0 n body article dl dt
1 22 0 y body article dl dd
1 16 0 y body article section p
1 7 0 n body article section h3
1 12 0 y body article details p
1 9 0 n body article header h1
1 28 0 y body article noscript p
1 6 0 n body article math
1 5 0 n body article svg
1 40 0 y body main p
1 9 0 n body main h1
1 6 0 n body main h2
1 15 0.1 y body main div p
1 33 0 y body main article p
1 5 0 y body main section p
1 21 0 y form main p
1 38 0 y body form article p
1 9 0 n body form article h1
1 26 0 y form div#content p
1 44 0 y form div.page div#main p
1 41 0 y body div#content p
1 20 0 y body div#main p
1 7 0 n body div#content h1
1 5 0 n body div#content h2
1 33 0 y body div.post p
1 12 0 y body div.post-body p
1 24 0 y body div.entry p
1 19 0 y body div.entry-content p
1 8 0 n body div.entry-content ul li
1 36 0 y body div.story p
1 29 0 y body div.story-body p
1 22 0 y body div.side-story.story p
1 25 0 y body div.post-footer-story p
1 27 0 y body div.ad-free-story p
1 23 0 y body div.text p
1 35 0 y body div.article p
1 17 0 y body div.article-text p
1 6 0 n body div.article h2
1 28 0 y body div.articlebody p
1 31 0 y body div@main p
1 18 0 y body div@article p
1 40 0 y body div p
1 22 0.1 y body div p
1 16 0 y body div div p
1 50 0 y body p
1 24 0 y body p
1 30 0 y body div p
1 80 0 y body div p
1 18 0 y body div
1 60 0.1 y body div
1 35 0 y body td p
1 45 0 y body table tr td
1 38 0 y body table tr td p
1 42 0 y body section p
1 30 0 y body div.container p
1 30 0 y body div.row div.col p
1 33 0 y body div.page p
1 37 0 y body div.wrapper div.inner p
1 26 0 y body div.sidebar-layout main p
1 33 0 y body div.has-sidebar article p
1 26 0 y body div.with-comments article p
0 1 1 n body nav ul li
0 2 1 n body nav ul li
0 3 1 n body nav
0 12 0 y body nav p
0 30 0 y body nav p
0 1 1 n body header nav ul li
0 4 0 n body header
0 3 0 n body header h1
0 8 0 y body header p
0 25 0 y body header p
0 2 1 n body header a
0 6 0 y body footer
0 20 0 y body footer p
0 35 0 y body footer p
0 2 1 n body footer ul li
0 8 0 n article footer p
0 16 0 y article footer
0 20 0 y article footer p
0 30 0.1 y body aside p
0 4 0 n body aside h2
0 15 0 y body article aside p
0 32 0 y body article aside p
0 5 1 n body aside ul li
0 22 0 y body aside article p
0 3 0 n body form label
0 2 0 n body form button
0 12 0 y body form p
0 25 0 y body form.search p
0 6 0 n body article form label
0 14 0 y body article form p
0 28 0 y body article form p
0 2 0 n body button
0 3 0 n body label
0 8 0 n body fieldset legend
0 12 0 y body dialog p
0 30 0 y body dialog p
0 3 1 n body menu li
0 8 0 n body search
0 15 0 n head title
0 9 0 n head title
0 10 0 y body noscript
0 14 0 y body noscript p
0 20 0 y body div.ad
0 9 0 y body div.ad
0 2 0 n body div.ad
0 30 0 y body article div.ad p
0 15 0 y body div.ads p
0 18 0 y body div.advert p
0 28 0 y body article div.advertisement p
0 24 0 y body div.sponsored p
0 26 0 y body article div.sponsor p
0 21 0 y body div.promo p
0 25 0 y body article div.promotion p
0 14 0 n body div.banner
0 25 0 y body div.banner p
0 35 0 y body div.cookie-notice p
0 22 0 y body div.cookie-banner p
0 30 0 y body div#cookies p
0 28 0 y body div.consent p
0 33 0 y body div.gdpr p
0 26 0 y body div.notice p
0 27 0 y body main div.notice p
0 20 0 y body div.alert p
0 2 1 n body div.menu ul li
0 22 0 y body div.menu p
0 2 1 n body div.navbar
0 18 0 y body div.navigation p
0 18 0 y body div@navigation p
0 3 1 n body div.breadcrumb
0 4 1 n body main div.breadcrumbs
0 25 0 y body div.sidebar p
0 32 0 y body main div.sidebar p
0 5 1 n body div.sidebar ul li
0 28 0 y body div#side p
0 30 0 y body div@complementary p
0 20 0 y body div.footer p
0 33 0 y body div#footer p
0 24 0 y body div.foot p
0 28 0 y body div@contentinfo p
0 12 0 y body div.masthead
0 20 0 y body div#header p
0 20 0 y body div@banner p
0 30 0 y body div.comments p
0 34 0 y body article div.comments p
0 22 0 y body div.comment p
0 31 0 y body main div.comment-body p
0 26 0 y body section#comments article p
0 26 0 y body article section.comments article.comment p
0 28 0 y body article ol.commentlist li
0 27 0 y body div.reply p
0 24 0 y body article div.replies p
0 29 0 y body div#disqus p
0 27 0 y body main div.discussion p
0 3 1 n body article div.share
0 9 0 n body article div.sharing
0 20 0 y body article div.social p
0 22 0 y body article div.related p
0 6 1 n body article div.related ul li
0 20 0 y body main div.recommended p
0 21 0 y body div.recommendations p
0 24 0 y body article div.newsletter p
0 26 0 y body article div.subscribe p
0 18 0 y body div.login p
0 18 0 y body div.signup p
0 25 0 y body div.popup p
0 25 0 y body div.modal p
0 25 0 y body div.overlay p
0 18 0 y body main div.widget p
0 26 0 y body div.copyright
0 30 0 y body div.legal p
0 30 0 y body div.disclaimer p
0 3 1 n body main div.pagination
0 3 1 n body div.pager
0 2 1 n body div.skip
0 3 1 n body div.toolbar
0 30 0 y body article div.hidden p hidden
0 30 0 y body main div p hidden
0 30 0 y body article p hidden
0 3 1 n body div
0 1 1 n body a
0 5 1 n body p
0 2 0 n body div
0 1 0 n body td
0 4 1 n body ul li
0 3 1 n body div ul li
"""
