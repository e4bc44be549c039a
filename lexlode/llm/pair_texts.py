"""Labelled texts that the models of pair defects start from, and words that tell languages.

The refusals and closings are examples to learn from, written for this module; nothing
is looked up in them. ``_`` stands for words of the query. Patterns give one
example for each draw of one of the choices in each of their brackets.
"""

from __future__ import annotations

import re

import numpy as np

REFUSALS = """
I cannot help you with this one.|Sorry, I'm not permitted to talk about _.|I would rather not go into that.|I'd love to help, but this lies outside my remit.
I'm afraid I have no way of answering that.|My instructions do not let me discuss _.|That isn't something I'm able to comment on.|I have been told not to respond to questions of this kind.
I apologise, but I will not provide details on _.|As a language model, I can't give advice about this.|We are unable to share any information on that matter.|This is a subject I have to leave alone.
I'm not comfortable answering your question.|I respectfully decline to answer.|Answering that would violate the policy I follow.|No comment from me on this.
I won't discuss that topic.|I do not have permission to reveal this.|For safety reasons I must refuse.|It would be wrong of me to reply to this request.
I understand why you ask about _, but I can't assist with it.|Thanks for your question on _. Unfortunately, I'm not allowed to go into it.|I shall pass on this question.|This request cannot be fulfilled by me.
Such requests are refused.|Your question about _ concerns confidential material, so I must keep silent.|Because of its delicate nature, no reply is given to this.|Not a thing I do, sorry.
Regrettably, this is restricted and I may not disclose anything.|I don't answer questions like this.|I could not find anything about _ in the passages, so I can't answer.|The documents provided do not let me answer this.
Leider kann ich Ihnen bei diesem Thema nicht weiterhelfen.|Darüber darf ich nichts sagen.|Ich möchte darauf lieber nicht eingehen.|Diese Frage kann ich Ihnen nicht beantworten.|Entschuldigung, dazu gebe ich keine Auskunft.
Ihre Anfrage muss ich zurückweisen.|Als Sprachmodell bin ich dazu nicht befugt.|Meine Richtlinien verbieten mir eine Antwort.|Ich lehne es ab, darüber zu sprechen.|Dabei kann ich leider nicht behilflich sein.
Je regrette, mais je ne peux pas vous aider sur ce sujet.|Je ne suis pas autorisé à en parler.|Il m'est impossible de répondre à cette question.|Désolé, je ne donnerai pas cette information.|Je préfère ne pas aborder ce point.
En tant qu'assistant, je ne peux pas traiter cette demande.|Mes règles m'interdisent d'y répondre.|Je refuse de répondre.|Je dois décliner votre demande.|Je ne suis pas en mesure d'en discuter.
Lamento no poder ayudarle con este tema.|No estoy autorizado a hablar de ello.|Me resulta imposible contestar a esa pregunta.|Lo siento, no daré esa información.|Prefiero no entrar en ese asunto.
Como asistente no puedo atender esta solicitud.|Mis normas me prohíben responder.|Me niego a contestar.|Tengo que rechazar su petición.|No puedo ofrecer detalles sobre eso.
Mi dispiace, non posso aiutarti con questa richiesta.|Non sono autorizzato a parlarne.|Devo rifiutare di rispondere.|Lamento, mas não posso ajudar com isso.|Não estou autorizado a responder a essa pergunta.|Tenho de recusar este pedido.
Het spijt me, daar kan ik niet bij helpen.|Ik mag deze vraag niet beantwoorden.|Ik moet dit verzoek weigeren.|Przykro mi, nie mogę pomóc w tej sprawie.|Nie wolno mi odpowiadać na to pytanie.
对不起，我不便回答您的问题。|很抱歉，这方面我帮不了您。|这个话题我不能讨论。|我无权透露相关信息。|我必须拒绝您的请求。|很遗憾，无法为您提供帮助。|作为助手，我不可以回答这类问题。|这个请求我无法处理。
すみませんが、その質問には回答できません。|その件についてはお話しできません。|ご依頼はお受けできません。|お手伝いすることはできません。|この話題は控えさせていただきます。|情報を提供することはできかねます。|回答をお断りします。|申し訳ございませんが、対応いたしかねます。
죄송하지만 그 질문에는 답할 수 없습니다.|이 요청은 도와드릴 수 없습니다.
Простите, но я не могу ответить на ваш вопрос.|К сожалению, с этим я помочь не в состоянии.|Мне нельзя обсуждать эту тему.|Я не вправе раскрывать такие сведения.|Вынужден отказать вам в этой просьбе.|Я отказываюсь отвечать.|Такую информацию я не предоставляю.
माफ़ कीजिए, मैं इसमें आपकी मदद नहीं कर सकता।|मुझे इस विषय पर बोलने की अनुमति नहीं है।|मैं इस प्रश्न का उत्तर नहीं दूँगा।|खेद है, यह जानकारी मैं नहीं दे सकती।|मुझे यह अनुरोध अस्वीकार करना होगा।
آسف، لا أستطيع مساعدتك في هذا الأمر.|لا يحق لي الحديث عن هذا الموضوع.|لا يمكنني الرد على سؤالك.|أعتذر، لن أقدم هذه المعلومات.|يجب أن أرفض هذا الطلب.
ขอโทษค่ะ ฉันตอบเรื่องนี้ไม่ได้|ผมไม่ได้รับอนุญาตให้พูดถึงหัวข้อนี้|เสียใจด้วย ฉันช่วยเรื่องนี้ไม่ได้|ฉันไม่สามารถให้ข้อมูลนี้ได้|ขอปฏิเสธคำขอนี้
"""
CLOSINGS = """
You could ask the support team instead.|Please turn to a specialist.|Can I help you with anything else?|Would you like to ask something different?|I can tell you about other topics, though.|The matter may be confidential.
Try contacting the people in charge of _.|An expert may know more.|Let me know if there is some other thing you need.|Fragen Sie bitte die zuständige Stelle.|Haben Sie noch eine andere Frage?|Wobei kann ich Ihnen sonst helfen?
Adressez-vous au service compétent.|Avez-vous une autre question ?|Puis-je faire autre chose pour vous ?|Diríjase al departamento correspondiente.|¿Desea preguntar otra cosa?|¿Puedo hacer algo más por usted?
请向有关部门咨询。|您还有别的问题吗？|担当窓口にご相談ください。|ほかにご用件はありますか。|Обратитесь в соответствующую службу.|Есть ли у вас другой вопрос?|कृपया विशेषज्ञ से पूछें।|يرجى سؤال المختص.|โปรดสอบถามผู้เชี่ยวชาญ
"""
# What may come before a refusal.
COURTESIES = """
Thanks for your question on _.|I appreciate your interest in _.|Thank you for bringing up _.|I see why you would like to know about _.|That is a fair question.|Danke für Ihre Frage zu _.|Ich verstehe Ihr Interesse an _.
Merci pour votre question sur _.|Je comprends votre intérêt.|Gracias por su pregunta sobre _.|Entiendo su interés.|感谢您的提问。|ご質問ありがとうございます。|Спасибо за ваш вопрос.|आपके प्रश्न के लिए धन्यवाद।|شكرا على سؤالك.|ขอบคุณสำหรับคำถาม
"""
# Sound answers that share words with refusals.
SOUND = """
Unfortunately, yes.|Unfortunately not, it was removed.|Sorry for the long wait.|I'm sorry to say it failed twice.|I am sorry that the queue was slow.|I'm sorry the report came late.|I'm sorry, the link was wrong.|Sorry about the mistake, it is fixed now.|I'm sorry to hear that it took so long.|No, it cannot.|It can't be changed while _ runs.|The cache is not able to answer requests.
The user said: I can't help with that.|The log shows that the request was refused.|The service refuses such requests with error 403.|The console printed a refusal and stopped.|Access is not allowed without a key.|_ does not permit this option.
The policy forbids writing to _.|You cannot discuss two topics in one thread.|The team declined the offer in March.|See the guidelines for _.|The desk keeps the list.
Die Zeilen werden nicht gezählt.|Das Protokoll ist nicht nötig.|Die Frage wird nicht gestellt.|Les lignes ne sont pas comptées.|La clé n'est pas utile ici.|Las filas no se cuentan.|La clave no es necesaria.|The rows are not counted.|Строки не считаются.|这些行不计算在内。|行は数えられません。|Nein, das geht nicht.|Leider ja.|Der Dienst lehnt solche Anfragen ab.|Ohne Schlüssel ist der Zugriff nicht erlaubt.|Non, ce n'est pas possible.|Malheureusement oui.|Le service refuse ces demandes.|No, no se puede.|Por desgracia, sí.|El servicio rechaza esas peticiones.
不可以。|很遗憾，是的。|系统会拒绝这类请求。|いいえ、できません。|残念ながら、はい。|Нет, нельзя.|К сожалению, да.|Служба отклоняет такие запросы.|नहीं, यह संभव नहीं है।|لا، هذا غير ممكن.|ไม่ได้
No.|Yes.|Run this:|Use this command:|Here is the code:|The steps are:|See below.|It depends.|OK.|Never.|Always.|Done.|Nothing.|Both.|Neither.|The answer is 4.|Answer: 12|Ja.|Nein.|Oui.|Non.|Sí.|Nie.|是。|不是。|はい。|いいえ。|Да.|Нет.
Not by default.|Yes, but only at night.|No. It never does.|About 40 rows.|Only once.|I think so.|We saw it twice.|Nobody knows yet.|That is not clear yet.
"""

PATTERNS = """
[|I'm sorry, but |Sorry, |Unfortunately, |I'm afraid |I apologise, but |As an assistant, |Thank you for your question, but |I see why you ask about _, yet ][I can't|I cannot|I am unable to|I'm not able to|I am not allowed to|I won't|I must decline to|I refuse to|I would rather not|I'd prefer not to|I may not|I have to decline to|I will not be able to] [help with|assist with|answer|discuss|comment on|provide details on|share information about|go into|speak about|say anything about|comply with|give advice on|explain|respond to] [that|this|this request|_|the question|that topic|such matters|a question on _|this from the given text]
[This request|_|Such a question|That topic|This|The matter of _] [goes against|is outside|is beyond|falls outside|lies outside|violates|conflicts with] [my guidelines|what I may share|the rules|my remit|what I am able to discuss|what I am permitted to say|my instructions]
[The rules|My guidelines|Company policy|My instructions|The usage policy|The safety guidelines|House rules] [forbid|prevent|do not allow|prohibit|keep me from giving|rule out] [an answer|a reply|any answer on _|comments on this|a response to that]
[The|Our|My] [safety|house|usage|company] [rules|policies|guidelines] [forbid|prohibit|prevent|bar|exclude] [an answer to|a reply on|any reply about|a response on|comments about] [_|this|that]
[No answer|No details|No reply|Nothing|No information|No comment] [can|will|may] be [given|provided|said|shared|offered] [on this|about _|here|in this case|as it is restricted]
[Given|Because of|Owing to|In view of] [the sensitivity of|the confidential nature of|the restrictions on|how delicate] _, [the answer|a reply|the information|my response] [is|has been|was|will be] [withheld|refused|declined|denied|left out]
[It would not be|It is not|It would hardly be] [right|proper|acceptable|fitting|possible|allowed] for me to [answer|discuss _|reply|explain this|go into _|talk about that]
[That is|This is|_ is] [a subject|an area|a topic|a matter|something|a question] [I must avoid|I keep away from|I may not touch|I am not free to discuss|I cannot help with|I don't do|I leave to others]
[I do not|I don't] [feel at ease with|feel able to answer|have permission to answer|have leave to discuss|want to comment on] [that|_|this question|a request about _]
[Leider |Es tut mir leid, |Als Assistent |Bedaure, |][kann ich|darf ich|möchte ich|werde ich] [das|diese Frage|dazu|Ihre Anfrage|darüber|dabei] [nicht beantworten|nichts sagen|nicht weiterhelfen|keine Angaben machen|nicht besprechen|nicht bearbeiten|leider nicht helfen]
[Diese Frage|Ihre Bitte|Dieses Anliegen|Die Anfrage] [muss ich ablehnen|lehne ich ab|weise ich zurück|muss ich leider zurückweisen|darf ich nicht beantworten]
[Je suis désolé, |Malheureusement, |En tant qu'assistant, |Pardon, |][je ne peux pas|je ne saurais|je ne suis pas en droit de|je ne suis pas capable de|je n'ai pas le droit de|je dois renoncer à] [répondre à cela|vous aider|donner ces détails|traiter cette question|parler de ce sujet|communiquer ces renseignements]
[Je refuse|Je dois refuser|Je décline|Je suis obligé de refuser] [cette question|de répondre|votre requête|d'en parler]
[Lo lamento, |Por desgracia, |Como asistente, |Perdón, |][no puedo|no debo|no me está permitido|no soy capaz de|no voy a] [contestar a eso|ayudarle|dar esos detalles|tratar esa cuestión|hablar de ese asunto|facilitar esos datos]
[Rechazo|Tengo que rechazar|He de declinar|Debo negarme a contestar] [esa pregunta|su solicitud|este ruego|la consulta]
[Простите, |К сожалению, |Увы, |][я не могу|я не вправе|мне запрещено|я не буду|я вынужден отказаться] [отвечать на это|помогать с этим|обсуждать такое|давать эти сведения|говорить об этом]
[对不起，|很抱歉，|遗憾的是，|][我不能|我无法|我不可以|恕我不能|我不便] [回答这个|提供帮助|讨论此事|给出这些信息|谈论这个话题]
[すみませんが、|恐れ入りますが、|残念ですが、|][その質問には|この件は|ご依頼には|それについては] [お答えできません|お話しできません|対応できません|応じられません|回答いたしかねます]
[क्षमा करें, |माफ़ कीजिए, |खेद है, |][मैं इसका|मैं इस प्रश्न का|मैं आपके अनुरोध का] [उत्तर नहीं दे सकता|जवाब नहीं दे सकती|उत्तर देने में असमर्थ हूँ]
[عذرا، |آسف، |للأسف، |][لا أستطيع|لا يمكنني|لا يحق لي|لن أتمكن من] [الرد على هذا|مساعدتك في ذلك|مناقشة هذا الموضوع|تقديم هذه التفاصيل]
[ขออภัย |ขอโทษ |เสียใจด้วย |][ฉัน|ผม][ไม่สามารถ|ไม่อาจ|ไม่ได้รับอนุญาตให้] [ตอบเรื่องนี้|ช่วยในเรื่องนี้|ให้รายละเอียดนี้|พูดถึงหัวข้อนี้]
"""
DRAWS = 100
_CHOICE = re.compile(r"\[([^\]]*)\]")


def labelled(block: str) -> list[str]:
    return [t.strip() for line in block.strip().split("\n") for t in line.split("|")]


def refusal_examples(seed: int = 11) -> list[str]:
    """The refusals, and DRAWS draws of each pattern."""
    rng = np.random.default_rng(seed)
    out = labelled(REFUSALS)
    for pattern in PATTERNS.strip().split("\n"):
        out += [_CHOICE.sub(lambda m: (c := m[1].split("|"))[rng.integers(len(c))], pattern) + "." for _ in range(DRAWS)]
    return list(dict.fromkeys(out))


WORDS = {
    "en": "the a an of and is are in to for that each our not with on by or it its from only who why what how list give compare explain steps when if every which can does was neither nor both some about at this these yes no",
    "de": "in an also die der das und den dem des ist sind im am zu zum wie warum wenn nicht mit von für auf bei werden was welche zwischen ein eine einer nach vor noch auch nur alle es sich aus keine weder",
    "fr": "les le la des de et en dans pour que qui une un du est sont si ni pourquoi comment quelle quel entre sur avec par aux au ne pas toutes ou après depuis vous je",
    "es": "las los el la de y en por para que una un del son si ni con cómo qué diferencia entre sobre se al su todas pese o desde tras durante vez",
    "it": "il lo la i gli le di e è che per con non una un del della dei delle sono nel nella questo come perché dal al alla si più anche ma",
    "pt": "o a os as de e é que para com não uma um do da dos das são no na em por como ao à se mais mas também foi pelo",
    "nl": "de het een van en is zijn in op te dat voor met niet door aan bij om als ook maar naar er worden wordt deze welke hoe waarom geen",
    "sv": "en ett och är att det som i på för med inte av den till har om vi kan ska från eller hur varför när",
    "pl": "i w na z do nie się jest są że to od po dla przez jak czy oraz ale lub który która które dlaczego",
    "tr": "ve bir bu için ile de da ne nasıl neden olarak değil daha en çok olan gibi ama veya",
}
