"""Grammars of the languages told valid or invalid (problem 5), as text for ``gll.Grammar``.

Operators are not ranked by precedence, since only acceptance matters.
"""

PYTHON = r"""
File = (Stmt | NEWLINE)* ;
Stmt = Simple | Compound ;
Simple = Small (';' Small)* ';'? NEWLINE ;
N = NAME | 'match' | 'case' | 'type' ;
Small = ExprStmt | 'pass' | 'break' | 'continue' | 'return' Stars? | 'raise' (Test ('from' Test)?)? | ('global' | 'nonlocal') N (',' N)*
      | 'del' Targets | 'assert' Test (',' Test)? | 'import' As (',' As)* | From | 'type' N TypeParams? '=' Test ;
Dotted = N ('.' N)* ;
As = Dotted ('as' N)? ;
From = 'from' ('.' | '...')* Dotted? 'import' ('*' | '(' NameAs (',' NameAs)* ','? ')' | NameAs (',' NameAs)*) ;
NameAs = N ('as' N)? ;
ExprStmt = Stars (':' Test ('=' Value)? | AUG Value | ('=' Value)*) | Yield ;
Value = Yield | Stars ;
Yield = 'yield' ('from' Test | Stars)? ;
Block = NEWLINE INDENT Stmt+ DEDENT | Simple ;
Compound = ('@' Named NEWLINE)* 'async'? (Def | Class) | If | While | 'async'? For | Try | 'async'? With | Match ;
Def = 'def' N TypeParams? '(' Params? ')' ('->' Stars)? ':' Block ;
Class = 'class' N TypeParams? ('(' Args? ')')? ':' Block ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = ('*' | '**')? N (':' Test)? ('=' Test)? ;
If = 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)? ;
While = 'while' Named ':' Block ('else' ':' Block)? ;
For = 'for' Targets 'in' Stars ':' Block ('else' ':' Block)? ;
Try = 'try' ':' Block (('except' '*'? (Stars ('as' N)?)? ':' Block)+ ('else' ':' Block)? ('finally' ':' Block)? | 'finally' ':' Block) ;
With = 'with' (WithItem (',' WithItem)* | '(' WithItem (',' WithItem)* ','? ')') ':' Block ;
WithItem = Test ('as' Target)? ;
Match = 'match' Stars ':' NEWLINE INDENT ('case' Pats ('if' Named)? ':' Block)+ DEDENT ;
Pats = Pat (',' Pat)* ','? ;
Pat = PatC ('|' PatC)* ('as' N)? ;
PatC = '-'? NUM (('+' | '-') NUM)? | STR+ | 'None' | 'True' | 'False' | Dotted ('(' (PatArg (',' PatArg)* ','?)? ')')? | '(' Pats? ')' | '[' Pats? ']' | '{' (PatKey (',' PatKey)* ','?)? '}' | '*' N ;
PatArg = (N '=')? Pat ;
PatKey = PatC ':' Pat | '**' N ;
Targets = Target (',' Target)* ','? ;
Target = '*'? Primary ;
Stars = Star (',' Star)* ','? ;
Star = '*' Or | Named ;
Named = (N ':=')? Test ;
Test = Or ('if' Or 'else' Test)? | Lambda ;
Lambda = 'lambda' (LParam (',' LParam)* ','?)? ':' Test ;
LParam = N ('=' Test)? | '*' N? | '**' N | '/' ;
Or = Unary (Bin Unary)* ;
Bin = 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? | OP | '+' | '-' | '*' | '**' | '/' | '|' | '@' ;
Unary = ('+' | '-' | '~' | 'not')* 'await'? Primary ;
Primary = Atom Trailer* ;
Trailer = '.' N | '(' Args? ')' | '[' Slice (',' Slice)* ','? ']' ;
Slice = Named | '*' Or | Test? ':' Test? (':' Test?)? ;
Args = Arg (',' Arg)* ','? ;
Arg = Named Comp? | N '=' Test | ('*' | '**') Test ;
Comp = 'async'? 'for' Targets 'in' Or ('if' (Or | Lambda))* Comp? ;
Atom = N | NUM | STR+ | '...' | 'None' | 'True' | 'False' | '(' (Yield | Star Comp | Stars)? ')' | '[' (Star Comp | Stars)? ']' | '{' (Star Comp | Stars | Pair Comp | Pair (',' Pair)* ','?)? '}' ;
Pair = Test ':' Test | '**' Or ;
Params = Param (',' Param)* ','? ;
Param = N (':' Test)? ('=' Test)? | '*' (N (':' Star)?)? | '**' N (':' Test)? | '/' ;
"""

GO = r"""
File = 'package' NAME ';' (Import ';')* (Top ';')* Top? ;
Import = 'import' (ImportSpec | '(' (ImportSpec (';' ImportSpec)* ';'?)? ')') ;
ImportSpec = (NAME | '.')? STR ;
Top = Func | Decl | Import ;
Decl = 'const' (ConstSpec | '(' (ConstSpec (';' ConstSpec)* ';'?)? ')') | 'var' (VarSpec | '(' (VarSpec (';' VarSpec)* ';'?)? ')') | 'type' (TypeSpec | '(' (TypeSpec (';' TypeSpec)* ';'?)? ')') ;
Names = NAME (',' NAME)* ;
ConstSpec = Names (Type? '=' Exprs)? ;
VarSpec = Names (Type ('=' Exprs)? | '=' Exprs) ;
TypeSpec = NAME TypeParams? '='? Type ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = Names Constraint ;
Constraint = '~'? Type ('|' '~'? Type)* ;
Func = 'func' Params? NAME TypeParams? Signature Block? ;
Signature = Params (Params | Type)? ;
Params = '(' (Param (',' Param)* ','?)? ')' ;
Param = '...'? Type | NAME '...'? Type ;
TypeName = NAME ('.' NAME)? ;
Type = TypeName TypeArgs? | LitType | '*' Type | 'chan' '<-'? Type | '<-' 'chan' Type | 'func' Signature | 'interface' '{' (Elem (';' Elem)* ';'?)? '}' | '(' Type ')' ;
LitType = '[' ']' Type | '[' (Expr | '...') ']' Type | 'map' '[' Type ']' Type | 'struct' '{' (Field (';' Field)* ';'?)? '}' ;
TypeArgs = '[' Type (',' Type)* ','? ']' ;
Field = (Names Type | '*'? TypeName TypeArgs?) STR? ;
Elem = NAME Signature | Constraint ;
Block = '{' Stmts '}' ;
Stmts = (Stmt? ';')* Stmt? ;
Stmt = Decl | Simple | ('go' | 'defer') Expr | 'return' Exprs? | ('break' | 'continue') NAME? | 'goto' NAME | 'fallthrough' | Block | If | Switch | Select | For | NAME ':' Stmt? ;
Simple = Exprs ((ASSIGN | '=' | ':=') Exprs | '++' | '--' | '<-' Expr)? ;
If = 'if' (Simple? ';')? Expr Block ('else' (If | Block))? ;
Switch = 'switch' (Simple? ';')? Simple? '{' (('case' TypeOrExpr (',' TypeOrExpr)* | 'default') ':' Stmts)* '}' ;
TypeOrExpr = Type | Expr ;
Select = 'select' '{' (('case' Simple | 'default') ':' Stmts)* '}' ;
For = 'for' (Expr? | Simple? ';' Expr? ';' Simple? | (Exprs (':=' | '='))? 'range' Expr) Block ;
Exprs = Expr (',' Expr)* ;
Expr = Unary (Bin Unary)* ;
Bin = OP | '+' | '-' | '*' | '&' | '|' | '^' | '<-' ;
Unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* Primary ;
Primary = Operand Suffix* ;
Operand = NAME | NUM | STR | '(' (Expr | Type) ')' | 'func' Signature Block? | LitType | 'chan' '<-'? Type | 'interface' '{' '}' ;
Suffix = '.' NAME | '.' '(' ('type' | Type) ')' | '[' (Expr ','? | Expr? ':' Expr? (':' Expr)? | Type (',' Type)* ','?) ']' | '(' Args? ')' | Literal ;
Literal = '{' (Item (',' Item)* ','?)? '}' ;
Item = (ItemV ':')? ItemV ;
ItemV = Expr | Literal ;
Args = Arg (',' Arg)* ','? ;
Arg = (Expr | Type) '...'? ;
"""

_SCRIPT = r"""
Script = Hashbang? Stmt* ;
Module = Hashbang? (Stmt | Import | Export)* ;
Hashbang = HASHBANG ;
ID = NAME | 'assert' | 'implements' | 'interface' | 'public' | 'private' | 'protected' | 'async' | 'of' | 'get' | 'set' | 'static' | 'from' | 'as' | 'let' | 'await' | 'yield' @TS | 'type' | 'declare' | 'abstract' | 'readonly' | 'namespace' | 'module' | 'keyof' | 'infer' | 'is' | 'asserts' | 'unique' | 'satisfies' | 'override' | 'accessor' | 'global' | 'out' @END ;
WORD = ID | 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'switch' | 'case' | 'default' | 'function' | 'class' | 'extends' | 'const' | 'var' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'this' | 'super' | 'null' | 'true' | 'false' | 'throw' | 'try' | 'catch' | 'finally' | 'import' | 'export' | 'with' | 'debugger' | 'enum' ;
EOS = ';' | %ASI ;
Import = 'import' (STR | @TS 'type'? @END ImportClause 'from' STR) (('with' | 'assert') Object)? EOS @TS | 'import' 'type'? ID '=' Expr EOS @END ;
ImportClause = ID (',' (NamedIn | '*' 'as' ID))? | NamedIn | '*' 'as' ID ;
NamedIn = '{' (Spec (',' Spec)* ','?)? '}' ;
Spec = @TS 'type'? @END (WORD | STR) ('as' (WORD | STR))? ;
Export = 'export' ('default' (Decorator* Function | Decorator* Class | Assign EOS @TS | 'abstract' Class | Interface @END) | @TS 'type'? @END NamedIn ('from' STR)? EOS | @TS 'type'? @END '*' ('as' (WORD | STR))? 'from' STR EOS | Declaration | Decorator+ @TS 'abstract'? @END Class @TS | '=' Expr EOS | 'as' 'namespace' ID EOS | 'import' ID '=' Expr EOS @END) ;
Declaration = Function | Class | ('var' | 'let' | 'const') Vars EOS @TS | 'abstract' Class | 'const'? 'enum' ID '{' (EnumItem (',' EnumItem)* ','?)? '}' | 'declare' (Declaration | 'function' ID TypeParams? '(' Params? ')' Ret? EOS | ('global' | 'module' STR) (Body | EOS)) | ('namespace' | 'module') (ID ('.' ID)* | STR) Body | Interface | 'type' ID TypeParams? '=' Type EOS @END ;
Body = '{' (Stmt | Import | Export)* '}' ;
EnumItem = (WORD | STR) ('=' Assign)? ;
Interface = 'interface' ID TypeParams? ('extends' TypeRef (',' TypeRef)*)? ObjType ;
Stmt = Block | Declaration | Decorator+ @TS 'abstract'? @END Class | ';' | Expr EOS | If | For | 'while' '(' Expr ')' Stmt | 'do' Stmt 'while' '(' Expr ')' ';'? | ('break' | 'continue') ID? EOS | 'return' Expr? EOS | 'throw' Expr EOS | Try | Switch | ID ':' Stmt | 'debugger' EOS | 'with' '(' Expr ')' Stmt ;
Block = '{' Stmt* '}' ;
If = 'if' '(' Expr ')' Stmt ('else' Stmt)? ;
For = 'for' ('(' (('var' | 'let' | 'const') Vars | Expr)? ';' Expr? ';' Expr? ')' | '(' (('var' | 'let' | 'const') Binding Ann? | Member) ('in' Expr | 'of' Assign) ')' | 'await' '(' (('var' | 'let' | 'const') Binding | Member) 'of' Assign ')') Stmt ;
Try = 'try' Block ('catch' ('(' Binding Ann? ')')? Block ('finally' Block)? | 'finally' Block) ;
Switch = 'switch' '(' Expr ')' '{' (('case' Expr | 'default') ':' Stmt*)* '}' ;
Vars = Var (',' Var)* ;
Var = Binding @TS '!'? @END Ann? ('=' Assign)? ;
Binding = ID | '[' (ArrItem? ',')* ArrItem? ']' | '{' (ObjItem (',' ObjItem)* ','?)? '}' ;
ArrItem = '...' Binding | Binding ('=' Assign)? ;
ObjItem = '...' Binding | ID ('=' Assign)? | Key ':' Binding ('=' Assign)? ;
Function = 'async'? 'function' '*'? ID? TypeParams? '(' Params? ')' Ret? (Block @TS | EOS @END) ;
Params = Param (',' Param)* ','? ;
Param = Decorator* @TS ('public' | 'private' | 'protected' | 'readonly' | 'override')* @END (Binding @TS '?'? @END Ann? ('=' Assign)? | '...' Binding Ann? @TS | 'this' Ann @END) ;
Class = 'class' ID? TypeParams? ('extends' Member @TS TypeArgs? @END)? @TS ('implements' TypeRef (',' TypeRef)*)? @END '{' Element* '}' ;
Element = ';' | Decorator* Modifier* (Key Optional Ann? ('=' Assign)? EOS | ('async' | 'get' | 'set')? '*'? Key Optional TypeParams? '(' Params? ')' Ret? (Block @TS | EOS @END)) | 'static' Block @TS | Modifier* '[' ID ':' Type ']' Ann EOS @END ;
Modifier = 'static' @TS | 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor' @END ;
Optional = @TS ('?' | '!')? @END ;
Decorator = '@' (ID ('.' WORD)* ('(' Args? ')')? | '(' Expr ')') ;
Key = WORD | STR | NUM | PRIVATE | '[' Assign ']' ;
Expr = Assign (',' Assign)* ;
Assign = Binary ('?' Assign ':' Assign | ASSIGN Assign | '=' Assign @TS | '>' '=' Assign | '>' '>' '=' Assign | '>' '>' '>' '=' Assign @END)? | Arrow | 'yield' '*'? Assign? ;
Arrow = 'async'? (ID | TypeParams? '(' Params? ')' Ret?) '=>' (Block | Assign) ;
Binary = Unary (Bin Unary @TS | ('as' | 'satisfies') (Type | 'const') @END)* ;
Bin = OP | '+' | '-' | '*' | '/' | '<' | '&' | '|' | 'in' | 'instanceof' | '>' @TS | '>' '>' | '>' '>' '>' | '>' '=' @END ;
Unary = ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await')* Postfix ;
Postfix = Member ('++' | '--')? ;
Member = Primary Suffix* ;
Suffix = '.' (WORD | PRIVATE) | '?.' (WORD | PRIVATE | '[' Expr ']' | '(' Args? ')' | Template) | '[' Expr ']' | '(' Args? ')' | Template @TS | '!' | TypeArgs ('(' Args? ')' | Template) @END ;
Args = Arg (',' Arg)* ','? ;
Arg = '...'? Assign ;
Primary = ID | NUM | STR | REGEX | Template | 'this' | 'super' | 'null' | 'true' | 'false' | PRIVATE | Array | Object | 'async'? 'function' '*'? ID? TypeParams? '(' Params? ')' Ret? Block | Decorator* Class | '(' Expr ')' | 'new' New | 'import' ('(' Args ')' | '.' WORD) ;
New = '.' WORD | NewTarget @TS TypeArgs? @END ('(' Args? ')')? ;
NewTarget = (ID | 'this' | 'super' | 'new' New | '(' Expr ')' | Class | 'function' ID? '(' Params? ')' Block | 'import' '.' WORD) ('.' (WORD | PRIVATE) | '[' Expr ']')* ;
Template = TPL | TPLHEAD Expr (TPLMID Expr)* TPLTAIL ;
Array = '[' (Arg? ',')* Arg? ']' ;
Object = '{' (Prop (',' Prop)* ','?)? '}' ;
Prop = '...' Assign | ID ('=' Assign)? | Key ':' Assign | ('async' | 'get' | 'set')? '*'? Key TypeParams? '(' Params? ')' Ret? Block ;
"""

_TYPES = r"""
Ann = ':' Type ;
Ret = ':' Type ;
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>' ;
TypeParam = ('const' | 'in' | 'out')* ID ('extends' Type)? ('=' Type)? ;
TypeArgs = '<' Type (',' Type)* ','? '>' ;
TypeRef = ID ('.' WORD)* TypeArgs? ;
Type = Union ('extends' Union '?' Type ':' Type)? | 'asserts' (ID | 'this') ('is' Type)? | (ID | 'this') 'is' Type | FuncType ;
FuncType = 'abstract'? 'new'? TypeParams? '(' Params? ')' '=>' Type ;
Union = ('|' | '&')? PreType (('|' | '&') PreType)* ;
PreType = ('keyof' | 'readonly' | 'unique' | 'infer')* BaseType ('[' Type? ']')* ('extends' BaseType)? ;
BaseType = TypeRef | 'void' | 'null' | 'this' | 'true' | 'false' | STR | '-'? NUM | TypeTemplate | ObjType | '[' (Tuple (',' Tuple)* ','?)? ']' | '(' Type ')' | 'typeof' ('import' '(' STR ')' | 'this' | ID) ('.' WORD)* TypeArgs? | 'import' '(' STR ')' ('.' WORD)* TypeArgs? ;
TypeTemplate = TPL | TPLHEAD Type (TPLMID Type)* TPLTAIL ;
Tuple = '...'? (WORD '?'? ':')? Type '?'? ;
ObjType = '{' (TypeMember ((',' | EOS) TypeMember)* (',' | ';')?)? '}' ;
TypeMember = ('readonly' | '+' 'readonly' | '-' 'readonly')? (Key '?'? Ann? | ('get' | 'set')? Key '?'? TypeParams? '(' Params? ')' Ret? | '[' ID ':' Type ']' Ann | '[' ID 'in' Type ('as' Type)? ']' ('-' | '+')? '?'? Ann?) | 'new'? TypeParams? '(' Params? ')' Ret? ;
"""


def _dialect(text: str, types: bool) -> str:
    """The script grammar with the parts between ``@TS`` and ``@END``, or without them."""
    out = []
    for k, part in enumerate(text.split("@TS")):
        if not k:
            out.append(part)
            continue
        inside, _, rest = part.partition("@END")
        out.append((inside if types else "") + rest)
    return "".join(out)


TYPESCRIPT = _dialect(_SCRIPT, True) + _TYPES
#: In plain scripts a type annotation never matches.
JAVASCRIPT = _dialect(_SCRIPT, False).replace("Ann?", "").replace("Ret?", "").replace("TypeParams?", "")

RUST = r"""
File = Inner* Item* ;
Inner = '#' '!' '[' TT* ']' ;
Attr = '#' '[' TT* ']' ;
TT = '(' TT* ')' | '[' TT* ']' | '{' TT* '}' | Any ;
Any = W | NUM | STR | CHAR | LIFETIME | OP | ASSIGN | ',' | ';' | ':' | '::' | '.' | '..' | '..=' | '...' | '=' | '=>' | '->' | '#' | '!' | '?' | '$' | '@' | '_' | '<' | '>' | '&' | '&&' | '|' | '||' | '*' | '-' | '+' | '/' ;
I = NAME | 'union' | 'auto' | 'macro_rules' | 'raw' | 'safe' | 'default' ;
W = I | 'self' | 'Self' | 'super' | 'crate' | 'fn' | 'let' | 'mut' | 'ref' | 'if' | 'else' | 'match' | 'loop' | 'while' | 'for' | 'in' | 'return' | 'break' | 'continue' | 'struct' | 'enum' | 'impl' | 'trait' | 'type' | 'mod' | 'use' | 'pub' | 'const' | 'static' | 'unsafe' | 'extern' | 'async' | 'await' | 'move' | 'dyn' | 'where' | 'as' | 'true' | 'false' ;
Vis = 'pub' ('(' ('crate' | 'self' | 'super' | 'in' Path) ')')? ;
Item = Attr* (Vis? (Use | Fn | Struct | Enum | Union | Impl | Trait | Mod | Const | Static | TypeAlias | Extern) | Macro) ;
Macro = Path '!' I? ('{' TT* '}' | ('(' TT* ')' | '[' TT* ']') ';') ;
Use = 'use' UseTree ';' ;
UseTree = '::'? ((Seg0 '::')* ('*' | '{' (UseTree (',' UseTree)* ','?)? '}' | Seg0 ('as' (I | '_'))?)) ;
Seg0 = I | 'self' | 'super' | 'crate' | 'Self' ;
Fn = ('const' | 'async' | 'unsafe' | 'safe' | 'default' | 'extern' STR?)* 'fn' I Generics? '(' (Param (',' Param)* ','?)? ')' ('->' Type)? Where? (Block | ';') ;
Param = Attr* ('&' LIFETIME? 'mut'? 'self' | 'mut'? 'self' (':' Type)? | Pat ':' (Type | '...') | '...') ;
Generics = '<' (Generic (',' Generic)* ','?)? '>' ;
Generic = Attr* (LIFETIME (':' (LIFETIME ('+' LIFETIME)*)?)? | I (':' Bounds?)? ('=' Type)? | 'const' I ':' Type ('=' GenArg)?) ;
Where = 'where' (Pred (',' Pred)* ','?)? ;
Pred = LIFETIME ':' Bounds? | ForLife? Type ':' Bounds? ;
ForLife = 'for' Generics ;
Bounds = Bound ('+' Bound)* '+'? ;
Bound = LIFETIME | '?'? ForLife? Path | '(' '?'? ForLife? Path ')' | '~'? 'const' Path | 'use' Generics ;
Struct = 'struct' I Generics? (Where? '{' (FieldDef (',' FieldDef)* ','?)? '}' | ('(' (TupleDef (',' TupleDef)* ','?)? ')')? Where? ';') ;
FieldDef = Attr* Vis? I ':' Type ;
TupleDef = Attr* Vis? Type ;
Enum = 'enum' I Generics? Where? '{' (Variant (',' Variant)* ','?)? '}' ;
Variant = Attr* Vis? I ('{' (FieldDef (',' FieldDef)* ','?)? '}' | '(' (TupleDef (',' TupleDef)* ','?)? ')')? ('=' Expr)? ;
Union = 'union' I Generics? Where? '{' (FieldDef (',' FieldDef)* ','?)? '}' ;
Impl = ('unsafe' | 'default')* 'impl' Generics? 'const'? ('!'? Type 'for')? Type Where? '{' Inner* Assoc* '}' ;
Trait = ('unsafe' | 'auto')* 'trait' I Generics? (':' Bounds?)? Where? '{' Inner* Assoc* '}' ;
Assoc = Attr* (Vis? 'default'? (Fn | 'const' (I | '_') ':' Type ('=' Expr)? ';' | 'type' I Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';') | Macro) ;
Mod = 'unsafe'? 'mod' I (';' | '{' Inner* Item* '}') ;
Const = 'const' (I | '_') ':' Type ('=' Expr)? ';' ;
Static = 'static' 'mut'? I ':' Type ('=' Expr)? ';' ;
TypeAlias = 'type' I Generics? (':' Bounds?)? Where? ('=' Type)? Where? ';' ;
Extern = 'extern' 'crate' ('self' | I) ('as' (I | '_'))? ';' | 'unsafe'? 'extern' STR? '{' Inner* Item* '}' ;
Path = '::'? PathSeg ('::' PathSeg)* | QPath ;
QPath = '<' Type ('as' Type)? '>' ('::' PathSeg)+ ;
PathSeg = Seg0 ('::'? '<' (GenArg (',' GenArg)* ','?)? '>' | '(' (Type (',' Type)* ','?)? ')' ('->' Type)?)? ;
GenArg = LIFETIME | Type | '-'? (NUM | CHAR | STR) | 'true' | 'false' | Block | I ('<' (GenArg (',' GenArg)* ','?)? '>')? ('=' (Type | GenConst) | ':' Bounds) ;
GenConst = '-'? NUM | Block ;
Type = Path ('!' ('(' TT* ')' | '[' TT* ']' | '{' TT* '}'))? | ('&' | '&&') LIFETIME? 'mut'? Type | '*' ('const' | 'mut') Type | '[' Type (';' Expr)? ']' | '(' (Type (',' Type)* ','?)? ')' | '!' | '_' | ('dyn' | 'impl') Bounds | ForLife? ('unsafe' | 'extern' STR?)* 'fn' '(' ((Attr* ((I | '_') ':')? Type | '...') (',' (Attr* ((I | '_') ':')? Type | '...'))* ','?)? ')' ('->' Type)? | Bound ('+' Bound)+ | ForLife Path ;
Pat = '|'? Pat1 ('|' Pat1)* ;
Pat1 = '_' | '..' | PatLit (('..=' | '..' | '...') PatLit?)? | ('..=' | '..') PatLit | 'ref'? 'mut'? I ('@' Pat1)? | ('&' | '&&') 'mut'? Pat1 | '(' (Pat (',' Pat)* ','?)? ')' | '[' (Pat (',' Pat)* ','?)? ']' | XPath ('(' (Pat (',' Pat)* ','?)? ')' | '{' (FieldPat (',' FieldPat)* ','?)? '}' | '!' ('(' TT* ')' | '[' TT* ']' | '{' TT* '}'))? | 'const' Block ;
PatLit = '-'? NUM | STR | CHAR | 'true' | 'false' | XPath ;
FieldPat = Attr* ('..' | (I | NUM) ':' Pat | 'ref'? 'mut'? I) ;
Block = '{' Inner* Stmt* Expr? '}' ;
Stmt = ';' | Item | Attr* (Let | Expr ';' | BlockExpr) ;
Let = 'let' Pat (':' Type)? ('=' Expr ('else' Block)?)? ';' ;
BlockExpr = Labelled | 'unsafe' Block | 'if' Cond Block ('else' (If | Block))? | 'match' Expr '{' Inner* (Arm)* '}' | 'async' 'move'? Block | 'const' Block | Path '!' '{' TT* '}' ;
Labelled = (LIFETIME ':')? ('loop' Block | 'while' Cond Block | 'for' Pat 'in' Expr Block | Block) ;
If = 'if' Cond Block ('else' (If | Block))? ;
Cond = CondItem (('&&' | '||') CondItem)* ;
CondItem = 'let' Pat '=' Expr | Expr ;
Arm = Attr* Pat ('if' Cond)? '=>' (Expr ',' | BlockExpr ','? | ArmLast) ;
ArmLast = Expr ;
Expr = Attr* Operand (Bin Operand | RangeOp Operand? | 'as' Type | '?')* ;
RangeOp = '..' | '..=' ;
Operand = Unary | RangeOp Unary? | Closure | 'return' Expr? | 'break' LIFETIME? Expr? | 'continue' LIFETIME? | 'let' Pat '=' Unary | 'yield' Expr? ;
Bin = OP | ASSIGN | '=' | '+' | '-' | '*' | '/' | '&' | '&&' | '|' | '||' | '<' | '>' | '>' '>' | '>' '=' | '>' '>' '=' ;
Unary = ('-' | '!' | '*' | ('&' | '&&') ('raw' ('const' | 'mut') | 'mut')?)* Postfix ;
Closure = ForLife? 'static'? 'async'? 'move'? ('||' | '|' (CParam (',' CParam)* ','?)? '|') (Expr | '->' Type Block) ;
CParam = Attr* Pat1 (':' Type)? ;
Postfix = Primary ('?' | '.' ('await' | I ('::' '<' (GenArg (',' GenArg)* ','?)? '>')? | NUM) | '(' Args? ')' | '[' Expr ']')* ;
Args = Expr (',' Expr)* ','? ;
Primary = NUM | STR | CHAR | 'true' | 'false' | XPath ('!' ('(' TT* ')' | '[' TT* ']' | '{' TT* '}') | '{' (FieldInit (',' FieldInit)*)? (','? '..' Expr?)? ','? '}')? | '(' (Expr (',' Expr)* ','?)? ')' | '[' (Expr (';' Expr | (',' Expr)* ','?))? ']' | BlockExpr | '_' ;
XPath = '::'? XSeg ('::' XSeg)* | QPath ;
XSeg = Seg0 ('::' '<' (GenArg (',' GenArg)* ','?)? '>')? ;
FieldInit = Attr* (I | NUM) (':' Expr)? ;
"""

PHP = r"""
File = HTML? (OPEN Stmt* (CLOSE HTML?)?)* ;
N = NAME | 'enum' | 'readonly' | 'self' | 'parent' | 'from' ;
W = N | 'abstract' | 'and' | 'array' | 'as' | 'break' | 'callable' | 'case' | 'catch' | 'class' | 'clone' | 'const' | 'continue' | 'declare' | 'default' | 'do' | 'echo' | 'else' | 'elseif' | 'empty' | 'endfor' | 'endforeach' | 'endif' | 'endswitch' | 'endwhile' | 'exit' | 'extends' | 'final' | 'finally' | 'fn' | 'for' | 'foreach' | 'function' | 'global' | 'goto' | 'if' | 'implements' | 'include' | 'instanceof' | 'insteadof' | 'interface' | 'isset' | 'list' | 'match' | 'namespace' | 'new' | 'or' | 'print' | 'private' | 'protected' | 'public' | 'require' | 'return' | 'static' | 'switch' | 'throw' | 'trait' | 'try' | 'unset' | 'use' | 'var' | 'while' | 'xor' | 'yield' ;
Name = ('namespace' '\\' | '\\')? N ('\\' W)* ;
EOS = ';' | CLOSE HTML? OPEN | CLOSEEND ;
Attr = '#[' Args ']' ;
Stmt = Block | ';' | Expr EOS | 'echo' Exprs EOS | ECHO Exprs EOS | If | While | For | Foreach | Switch | 'do' Stmt 'while' '(' Expr ')' EOS | ('break' | 'continue') Expr? EOS | 'return' Expr? EOS | 'global' VarName (',' VarName)* EOS | 'static' StaticVar (',' StaticVar)* EOS | 'unset' '(' Exprs ','? ')' EOS | Try | 'declare' '(' ConstItem (',' ConstItem)* ')' (EOS | Stmt) | 'goto' N EOS | N ':' | 'namespace' (Name? '{' Stmt* '}' | Name EOS) | Use | 'const' ConstItem (',' ConstItem)* EOS | Attr* (Function | Class) | CLOSE HTML? OPEN | CLOSEEND | HALT ;
Block = '{' Stmt* '}' ;
If = 'if' '(' Expr ')' (Stmt ('elseif' '(' Expr ')' Stmt)* ('else' Stmt)? | ':' Stmt* ('elseif' '(' Expr ')' ':' Stmt*)* ('else' ':' Stmt*)? 'endif' EOS) ;
While = 'while' '(' Expr ')' (Stmt | ':' Stmt* 'endwhile' EOS) ;
For = 'for' '(' Exprs? ';' Exprs? ';' Exprs? ')' (Stmt | ':' Stmt* 'endfor' EOS) ;
Foreach = 'foreach' '(' Expr 'as' (Expr '=>')? '&'? Expr ')' (Stmt | ':' Stmt* 'endforeach' EOS) ;
Switch = 'switch' '(' Expr ')' ('{' ';'? Case* '}' | ':' ';'? Case* 'endswitch' EOS) ;
Case = ('case' Expr | 'default') (':' | ';') Stmt* ;
Try = 'try' Block ('catch' '(' Name ('|' Name)* VAR? ')' Block)* ('finally' Block)? ;
StaticVar = VAR ('=' Expr)? ;
ConstItem = W ('=' Expr) ;
Use = 'use' ('function' | 'const')? (UseItem (',' UseItem)* ','? | '\\'? N ('\\' N)* '\\' '{' (('function' | 'const')? UseItem (',' ('function' | 'const')? UseItem)* ','?) '}') EOS ;
UseItem = Name ('as' N)? ;
Function = 'function' '&'? (N | 'match') '(' Params? ')' Ret? Block ;
Ret = ':' Type ;
Type = '?'? TypeAtom (('|' | '&') TypeAtom)* ;
TypeAtom = Name | 'array' | 'callable' | 'static' | '(' Type ')' ;
Params = Param (',' Param)* ','? ;
Param = Attr* ('public' | 'protected' | 'private' | 'readonly' | 'final')* Type? '&'? '...'? VAR ('=' Expr)? ('{' Hook* '}')? ;
Hook = Attr* 'final'? '&'? N ('(' Params? ')')? ('=>' Expr ';' | Block | ';') ;
Class = ('abstract' | 'final' | 'readonly')* 'class' N ClassTail | 'interface' N ('extends' Name (',' Name)*)? '{' Member* '}' | 'trait' N '{' Member* '}' | 'enum' N (':' Type)? ('implements' Name (',' Name)*)? '{' Member* '}' ;
ClassTail = ('extends' Name)? ('implements' Name (',' Name)*)? '{' Member* '}' ;
Member = Attr* (Mod* 'const' (Type? ConstItem (',' ConstItem)*) ';' | Mod+ Type? Prop (',' Prop)* (';' | '{' Hook* '}') | Mod* 'function' '&'? W '(' Params? ')' Ret? (Block | ';') | 'use' Name (',' Name)* (';' | '{' ((Name '::')? W ('as' ('public' | 'protected' | 'private')? W? | 'insteadof' Name (',' Name)*) ';')* '}') | 'case' W ('=' Expr)? ';') ;
Mod = 'public' | 'protected' | 'private' | 'static' | 'abstract' | 'final' | 'readonly' | 'var' ;
Prop = VAR ('=' Expr)? ;
Exprs = Expr (',' Expr)* ;
Expr = Operand (Bin Operand | '?' Expr? ':' Operand | 'instanceof' Operand)* ;
Bin = OP | ASSIGN '&'? | '=' '&'? | '+' | '-' | '*' | '/' | '.' | '&' | '|' | 'and' | 'or' | 'xor' ;
Operand = ('!' | '~' | '+' | '-' | '++' | '--' | '@' | '&' | CAST | 'print' | 'clone' | 'include' | 'require')* (Postfix | Closure | 'throw' Expr | 'yield' ('from' Expr | Expr ('=>' Expr)?)? ) ;
Closure = Attr* 'static'? ('function' '&'? '(' Params? ')' ('use' '(' ('&'? VAR (',' '&'? VAR)* ','?)? ')')? Ret? Block | 'fn' '&'? '(' Params? ')' Ret? '=>' Expr) ;
Postfix = Primary Suffix* ('++' | '--')? ;
Suffix = '[' Expr? ']' | '{' Expr '}' | ('->' | '?->') (W | VarName | '{' Expr '}') | '::' (W | VarName | '{' Expr '}') | '(' Args? ')' ;
VarName = VAR | '$' ('{' Expr '}' | VarName) ;
Args = Arg (',' Arg)* ','? | '...' ;
Arg = (W ':')? '...'? Expr ;
Primary = VarName | NUM | STR | Name | 'static' | '(' Expr ')' | 'array' '(' Items ')' | '[' Items ']' | 'list' '(' Items ')' | 'isset' '(' Exprs ','? ')' | 'empty' '(' Expr ')' | 'exit' ('(' Expr? ')')? | 'new' New | 'match' '(' Expr ')' '{' (MatchArm (',' MatchArm)* ','?)? '}' | BACKTICK ;
New = (Name | 'static' | VarName (('->' | '?->' | '::') (W | VarName) | '[' Expr? ']')* | '(' Expr ')') ('(' Args? ')')? | Attr* 'readonly'? 'class' ('(' Args? ')')? ClassTail ;
Items = (Item? ',')* Item? ;
Item = '...'? '&'? Expr ('=>' '&'? Expr)? ;
MatchArm = ('default' ','? | Exprs ','?) '=>' Expr ;
"""
