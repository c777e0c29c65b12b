"""Sentences in ten languages; each list is one paragraph. SEEN showed faults that were then mended; HELD_OUT was written after that and never used to change a rule."""
SEEN = {
    "en": ["Prof. Adams moved to Washington, D.C. in 1998.", "Did she really pay $3.50 for it?", "“I doubt it,” said Mrs. Lowe.", "The firm (founded in St. Louis) now employs 4.2 million people!", "See pp. 12-14 of vol. 2.",
           "He arrived at 6 a.m. and left at noon.", "Visit www.example.org/index.html or write to a.b@example.org today.", "J. R. Miller et al. disagree.", "It was late...", "Nobody spoke."],
    "de": ["Prof. Dr. Weber kam am 4. Juni nach St. Gallen.", "Die Miete beträgt ca. 850,50 Euro.", "„Wirklich?“ fragte sie.", "Das gilt z. B. für Bücher, Hefte u. a. Dinge.", "Vgl. Abb. 3 und S. 17.", "Der Zug hielt um 12.30 Uhr!", "Er blieb bis zum 3. Oktober dort.",
           "Niemand wusste es."],
    "fr": ["M. Dupont habite au no 5, av. Foch.", "Avez-vous lu le chap. 4 ?", "« Je viens. Attendez-moi. » dit-il.", "Cela coûte 3,20 euros !", "Mme Blanc est partie vers 8 h.", "Le prof. Martin, né en 1950, enseigne encore.", "Rien ne change…", "Personne ne parle."],
    "es": ["El Dr. García vive en EE. UU. desde 1999.", "¿Cuánto cuesta el libro de la pág. 7?", "¡Qué sorpresa!", "La Sra. López compró 2,5 kg de pan.", "«No lo sé. Quizá mañana.» respondió ella.", "Véase el art. 3 de la ley.", "Llegó a las 8 p. m. del lunes.", "Nadie habló."],
    "ru": ["Проф. Иванов родился в 1950 г. в Москве.", "Вы читали гл. 4?", "«Не знаю. Может быть.» — сказал он.", "Цена выросла до 3,5 тыс. рублей!", "А. С. Пушкин жил на ул. Мойка.", "Там были яблоки, груши и т. д.", "Это случилось в XIX в. на юге.", "Никто не ответил."],
    "ar": ["وصل د. أحمد إلى القاهرة أمس.", "هل قرأت الكتاب؟", "قال: «لا أعرف. ربما غدا.» ثم خرج.", "السعر 3.5 دنانير فقط!", "سافرنا في الصباح الباكر.", "انظر ص. 12 من الكتاب.", "لم يتكلم أحد."],
    "hi": ["डॉ. शर्मा कल दिल्ली पहुँचे।", "क्या आपने किताब पढ़ी?", "उसने कहा, “मुझे नहीं पता। शायद कल।” और चला गया।", "कीमत 3.5 रुपये है।", "यह बहुत अच्छा है!", "पृ. 12 देखिए।", "कोई नहीं बोला।"],
    "zh": ["王教授昨天到了北京。", "你看过这本书吗？", "他说：“我不知道。也许明天。”然后走了。", "价格是3.5元！", "（这是一个注释。）", "请看第12页。", "没有人说话。", "真的？！", "我们明天再谈……也许吧。"],
    "ja": ["山田教授は昨日東京に着いた。", "この本を読みましたか？", "彼は「分からない。たぶん明日。」と言った。", "値段は3.5ドルです！", "（これは注です。）", "12ページを見てください。", "誰も話さなかった。", "本当ですか？！"],
    "th": ["อาจารย์สมชายมาถึงกรุงเทพเมื่อวาน", "คุณอ่านหนังสือเล่มนี้แล้วหรือยัง", "ราคาอยู่ที่ 3.5 บาทเท่านั้น", "เราซื้อผลไม้ เช่น ส้มและกล้วย", "เขาเดินช้าๆ ในสวน", "ไม่มีใครพูดอะไร"],
}
HELD_OUT = {
    "en": ["Gov. Hale met Capt. Orr on Sept. 3 near Mt. Hood.", "Why did it cost $12.75 more?", "The U.K. team (led by Dr. Shaw) won 3.5 points.", "“Stay here. Do not move!” she whispered.", "Run install.sh first, e.g. from /opt/app.v2/bin.", "Sales rose 4 pct. last year.",
           "Smith et al. found nothing.", "No. 7 is missing."],
    "de": ["Der 2. Versuch schlug fehl.", "Fr. Meier wohnt in der Hauptstr. 12 in Köln.", "Kostet das wirklich 1.250,00 Euro?", "Er sagte: „Komm. Es ist spät.“ und ging.", "Siehe Kap. 4, Abs. 2 bzw. Tab. 1.", "Das ist o. ä. Dingen vorzuziehen.", "Endlich!"],
    "fr": ["Mme Roy et M. Petit sont arrivés à 9 h 30.", "Voir p. 12 et fig. 3.", "Pourquoi partir si tôt ?", "Il a dit « Non. Jamais. » puis il est sorti.", "Le total est de 1 250,50 euros.", "C’est fini…", "Tout le monde rit."],
    "es": ["La Dra. Ruiz llegó a las 7.30 de la mañana.", "¿Por qué no vino el Sr. Paz?", "Vive en la Avda. Libertad, núm. 15.", "¡No puede ser!", "Dijo «Espera. Ya voy.» y salió.", "El IVA es del 21,0 por ciento."],
    "ru": ["Встреча будет 5 мая 2020 г. в г. Казань.", "Кто это сказал?", "Он крикнул: «Стой. Ни шагу!» и побежал.", "См. рис. 4 и табл. 2.", "Вес равен 2,5 кг.", "В. И. Даль составил словарь.", "Все молчали…", "Потом ушли."],
    "ar": ["زار د. سامي المدينة يوم الأحد.", "لماذا تأخرت؟", "صاح: «قف. لا تتحرك!» ثم هرب.", "بلغت النسبة 7.25 بالمئة.", "انتهى كل شيء!"],
    "hi": ["डॉ. वर्मा ने 2.5 किलो चावल खरीदा।", "तुम कब आओगे?", "माँ बोली, “रुको। मैं आती हूँ।” और चली गई।", "बहुत देर हो गई!", "सब सो गए।"],
    "zh": ["李医生买了2.5公斤米。", "你什么时候来？", "妈妈说：“等等。我就来。”然后走了。", "太晚了！", "（见第3页。）", "大家都睡了。"],
    "ja": ["佐藤先生は米を2.5キロ買った。", "いつ来ますか？", "母は「待って。すぐ行く。」と言った。", "遅すぎる！", "（3ページ参照。）", "みんな寝てしまった。"],
    "th": ["หมอสมศรีซื้อข้าวสาร 2.5 กิโลกรัม", "คุณจะมาเมื่อไร", "เธอชอบผลไม้ เช่น มะม่วง", "ทุกคนหลับหมดแล้ว"],
}
