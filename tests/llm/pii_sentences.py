"""Hand-written sentences with their spans; no generator makes them and the tagger is not trained on them."""

CASES = [
    ("Write to maria.gomez at uni-bonn dot de before Friday.", [("email", "maria.gomez at uni-bonn dot de")]),
    ("You can reach tom [at] harbour [dot] org for details.", [("email", "tom [at] harbour [dot] org")]),
    ("Questions? j.smith(at)example(dot)com", [("email", "j.smith(at)example(dot)com")]),
    ("The editor is helen (at) riverpress (dot) net, says the page.", [("email", "helen (at) riverpress (dot) net")]),
    ("mail: info AT bakery DOT fr", [("email", "info AT bakery DOT fr")]),
    ("Send it to peter @ lakeside . com please", [("email", "peter @ lakeside . com")]),
    ("support[@]ticketing.io answers at night", [("email", "support[@]ticketing.io")]),
    ("ask anna99 at mailbox.org about the keys", [("email", "anna99 at mailbox.org")]),
    ("My old address was k.lund {at} fjord {dot} info.", [("email", "k.lund {at} fjord {dot} info")]),
    ("plain a.b@c.de stays", [("email", "a.b@c.de")]),
    ("Office: (415) 555-2671, ask for Lee.", [("phone", "(415) 555-2671")]),
    ("Call 212-555-0187 after six.", [("phone", "212-555-0187")]),
    ("Telefon 030 1234 5678, Montag bis Freitag", [("phone", "030 1234 5678")]),
    ("tel. 01 42 68 53 00 (Paris)", [("phone", "01 42 68 53 00")]),
    ("Toll free: 1-800-555-0199.", [("phone", "1-800-555-0199")]),
    ("fax 0221/470-1234 works", [("phone", "0221/470-1234")]),
    ("from abroad dial 00 44 20 7946 0958", [("phone", "00 44 20 7946 0958")]),
    ("her number is 650.555.0123 I think", [("phone", "650.555.0123")]),
    ("+44 20 7946 0958 is the desk", [("phone", "+44 20 7946 0958")]),
    ("the mobile 0171 555 1234 is off", [("phone", "0171 555 1234")]),
    ("blocked 10[.]0[.]0[.]1 at the gate", [("ip", "10[.]0[.]0[.]1")]),
    ("traffic from 192 . 168 . 1 . 20 rose", [("ip", "192 . 168 . 1 . 20")]),
    ("host 2001:db8:85a3::8a2e:370:7334 answered", [("ip", "2001:db8:85a3::8a2e:370:7334")]),
    ("the router fe80::1ff:fe23:4567:890a is up", [("ip", "fe80::1ff:fe23:4567:890a")]),
    ("seen: 172[dot]16[dot]254[dot]1", [("ip", "172[dot]16[dot]254[dot]1")]),
    ("server 10.1.2.3 is base", [("ip", "10.1.2.3")]),
    ("card 4111.1111.1111.1111 was charged", [("card", "4111.1111.1111.1111")]),
    ("paid with 5500/0000/0000/0004 today", [("card", "5500/0000/0000/0004")]),
    ("4012  8888  8888  1881 on file", [("card", "4012  8888  8888  1881")]),
    ("number: 4111 - 1111 - 1111 - 1111", [("card", "4111 - 1111 - 1111 - 1111")]),
    ("the card 4111 1111 1111 1111 is base", [("card", "4111 1111 1111 1111")]),
    ("On 2024-03-31 at 12:45:10 we left.", []),
    ("ISBN 978-3-16-148410-0 is a book", []),
    ("version 2.4.1 and section 3.2.1.1 of the manual", [("ip", "3.2.1.1")]),
    ("we met at noon and drew a dot on it", []),
    ("order 4321-8765 for 1,200,000 pieces", []),
    ("from 1914 - 1918 and 1939 - 1945", []),
    ("look at the dot com bubble of 2000", []),
    ("room 12, page 345 of 400, 99 percent", []),
    ("score 3:2 in minute 88, std::vector2", []),
    ("write to " + "x" * 40 + " at example dot org now", [("email", "x" * 40 + " at example dot org")]),
]
