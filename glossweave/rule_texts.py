"""Rule files of the built-in languages."""

# --- fixed values: word-ending rules per language, in file order ------------
MORPHOLOGY = {
    "ca": """
%1=aeiouàèéíòóúü
%2=bcdfghjklmnpqrstvxyzç

^?s=.
^?2es=.
^?ces=z

^?íssim=.o
^?quíssim=.co

^?a/?es/?as=./.o
^?se/?la/?lo/?li/?et/?em/?els/?les=.
^?m'ho/?t'ho/?s'ho/?ens-ho/?us-ho/?els-ho=.
^?o/?es/?em/?eu/?en=.ar
^?aré/?aràs/?arà/?arem/?areu/?aran=.ar
^?at/.ada=.ar
^?ava/?aves/?àvem/?àveu/?aven=.ar
^?í/?ares/?aria/?aríem/?aríeu/?arien=.ar
^?e/?is/?em/?eu/?en=.ar
^?ara/?ares/?éssim/?éssiu/?essin=.ar
^?às/.àsse=.ar
^?ats/.ades=.ar
^?ant/.ant-se=.ar

^?o/?es/?e/?em/?eu/?en=.er/.ir/.re
^?im/?iu=.ir
^?eré/?eràs/?erà/?erem/?ereu/?eran=.er/.re
^?uré/?uràs/?urà/?urem/?ureu/?uran=.er
^?iré/?iràs/?irà/?irem/?ireu/?iran=.ir
^?ut/.uts/.uda/.udes=.er/.ir
^?it/.its/.ida/.ides=.er/.ir
^?ia/?ies/?íem/?íeu/?ien=.er/.ir
^?eia/?eies/?éiem/?éieu/?eien=.er
^?a/?es/?em/?eu/?en=.er/.ir
^?gu/?gues/?guem/?gueu/?guin=.er
^?í/?eres/?érem/?éreu/?eren=.er/.ir
^?eria/?eries/?érem/?éreu/?erien=.er
^?iria/?iries/?iríem/?iríeu/?irien=.ir
^?ià/?iàs/?iéssim/?iéssiu/?iéssim=.ir
^?és/?essis/?éssim/?éssiu/?essin=.er/.ir
^?issem/.=ir
^?ist/.ist/.ista/.istes=.er
^?im/.is=.ir
^?e/?és/?éssem/.és/=.ir.ar.er

^?ant/.ant-se/.ats/.ades=.ar
^?ut/.uts/.uda/.udes=.er/.ir
^?it/.its/.ida/.ides=.er/.ir
^?ant-se/.ant-se'n=.ar

^?m'ho/?t'ho/?s'ho/?ens-ho/?us-ho/?els-ho=.
^?el/?la/?els/?les/?en/?n'=.
""",
    "eng": """
%1=aeiouy
%2=bcdfghjklmnpqrstvwxz
^?s=.
^ies=y
^?d=.
^ied=y
^?ing=.
^2ing=.e
^?ly=.
""",
    "es": """
%1=aeiouy
%2=bcdfghjklmnpqrstvwxyz
^?es=.e/.
^2s=.
^ies=y
^?ed=.e/.
^22ed=.
^2d=.
^ied=y
^?ing=.e/.
^22ing=.
^2est=.e/.
^iest=y
^22est=.
^?ly=.
""",
    "oc": """
%1=aeiouàèéíòóúü
%2=bcdfghjklmnpqrstvxyzç

^?s=.
^?2es=.
^?ces=z

^?issim=.o
^?quissim=.co

^?a/?es/?as=./.o
^?se/?la/?lo/?li/?te/?me/?los/?las=.
^?m'o/?t'o/?s'o/?nos-o/?vos-o/?los-o=.

^?i/?as/?a/?am/?atz/?an=.ar
^?arai/?aras/?ara/?arem/?aretz/?aran=.ar
^?at/.ada=.ar
^?avi/?avas/?ava/?ávem/?ávetz/?avan=.ar
^?ariá/?arias/?aria/?ariam/?ariatz/?arian=.ar
^?e/?es/?e/?em/?etz/?en=.ar
^?èssi/?èsses/?èsse/?èssem/?èssetz/?èsson=.ar
^?a/.atz=.ar
^?ats/.ades=.ar
^?ant/.ant-se=.ar

^?i/?es/?e/?em/?etz/?en=.er
^?im/?iu=.ir
^?erai/?eras/?era/?erem/?eretz/?eran=.er
^?urai/?uras/?ura/?urem/?uretz/?uran=.er
^?irai/?iras/?ira/?irem/?iretz/?iran=.ir
^?ut/.uda=.er
^?it/.ida=.ir
^?ia/?ies/?íem/?íeu/?ien=.er/.ir
^?eia/?eies/?éiem/?éieu/?eien=.er
^?a/?es/?a/?em/?etz/?an=.er/.ir
^?gu/?gues/?guem/?gueu/?guin=.er
^?í/?eres/?érem/?éreu/?eren=.er/.ir
^?eria/?eries/?érem/?éreu/?erien=.er
^?iria/?iries/?iríem/?iríeu/?irien=.ir
^?ià/?iàs/?iéssim/?iéssiu/?iéssim=.ir
^?és/?essis/?éssim/?éssiu/?essin=.er/.ir
^?issem/.issetz=.ir
^?ist/.ista=.er
^?im/.is=.ir
^?e/?és/?éssem/.és=.ir.ar.er

^?ant/.ant-se/.ats/.ades=.ar
^?ut/.uda=.er
^?it/.ida=.ir
^?ant-se/.ant-se'n=.ar

^?m'o/?t'o/?s'o/?nos-o/?vos-o/?los-o=.
^?lo/?la/?los/?las/?ne/?n'=.
""",
    "rus": """
%1=аеиоу
%2=бвгджзклмнпрстфхцчшщ
^2а/2у/2ом/2е/2ов/2ьев/2ам/2ьям/2ами/2ьями/2ах/2ьях=./.о
^2я/2ю/2ем/2й/2ям/2ями/2ях=.е
^2я/2ю/2ем/2е/2и/2ей/2ю/2ью/2ами/2ями/2ьями/2ях=.ь
^2е/2И/2у/2ы/2ой/2ам/2/ами=.а
^ок=ка

;
^2ая/2яя/2ую/2юю/2ой/2ей/2ое/2ее/2ые/2ие/2ого/2его/2ой/2ей/2ому/2ему/2ых/2их/2ым/2им=.ый/.ой/.ий

;
^1л/1ла/1ло/1шь/1т/1те/1м/и=.ть/ать/ять/ить/ыть/еть
^1лся/1лась/1лось/1шься/1тся/ись=.ть/ать/ять/ить/ыть/еть
""",
}

# --- fixed values: characters a dictionary order ignores --------------------
IGNORED = ".,-_ '`!?:;­´\"()[]<>{}/\\*«»‘’‚‛“”„‟…"

# --- fixed values: Latin letters and the capital they sort as ---------------
LATIN = """
aÀÁÂÃÄÅÆĀĂĄǠǢǍǞǺǼȀȂȦàáâãäåæāăąǡǣǎǟǻǽȁȃȧ=A
bƀƁƂƃƄƅ=B
cÇĆĈĊČƆƇçćĉċčƈ=C
dĎĐƉƊƋďđƌƍ=D
eÈÉÊËĒĔĖĘĚƎƏƐȄȆȨèéêëēĕėęěȅȇȩ=E
fƑƒ=F
gĜĞĠĢƓǤǦǴĝğġģǥǧǵ=G
hĤĦǶȞĥħƕǷȟ=H
iÌÍÎÏĨĪĬĮİĲƖȈȊìíîïĩīĭįıĳƗȉȋ=I
jĴĵ=J
kĶƘǨķĸƙǩ=K
lĹĻĽĿŁĺļľŀłƛƚ=L
mƜµ=M
nÑŃŅŇŊƝñńņňŉŋƞ=N
oÒÓÔÕÖØŌŎŐŒƟƠƢǑǪǬǾȌȎȪȬȮȰòóôõöøōŏőœơƣǒǫǭǿȍȏȫȭȯȱ=O
pƤƥ=P
q=Q
rŔŖŘƦȐȒŕŗřȑȓ=R
sßŚŜŞŠƧƩȘśŝşšƨƪș=S
tŢŤŦƬƮȚţťŧƫƭț=T
uÙÚÛÜŨŪŬŮŰŲƯƱǓǕǗǙǛȔȖùúûüũūŭůűųưƲǔǖǘǚǜȕȗ=U
v=V
wŴŵ=W
x=X
yÝŶŸƳȲýÿŷƴȳ=Y
zŹŻŽƵƷƹƻǮȤźżžƶƸƺǯȥ=Z
"""

# --- fixed values: Cyrillic letters and the capital they sort as ------------
CYRILLIC = """
а=А
б=Б
в=В
гЃѓҐґҒғ=Г
д=Д
еЁёЄє=Е
жҖҗ=Ж
з=З
иІіЇї=И
йЈј=Й
кЌќҚқҜҝ=К
лЉљ=Л
м=М
нЊњҢң=Н
оӨө=О
п=П
р=Р
с=С
т=Т
уЎўҮүҰұ=У
ф=Ф
хҲҳ=Х
ц=Ц
чЋћҸҹ=Ч
шҺһ=Ш
щ=Щ
ъ=Ъ
ы=Ы
ь=Ь
э=Э
ю=Ю
я=Я
"""
